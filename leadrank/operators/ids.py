"""Dense ids in arrival order without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.session import cut_lineage

# Dense arrival numbers: a block of this width holds at most this many rows of any group.
BLOCK_WIDTH = 1 << 18


def arrival_block(order: str | Column, width: int = BLOCK_WIDTH) -> Column:
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(width)).cast("long")


# `monotonically_increasing_id` counts in the low bits and puts the number of the partition above them.
_COUNTER_BITS = 33


def assign_ids(rows: DataFrame, order: str | list[str], id_column: str, start: int = 0) -> DataFrame:
    """Adds ids start+1, start+2, ... in the order of `order`, whose values may be sparse, hashed or texts.

    Rows are dealt out by range, sorted and counted within their partitions, and written with that count; this is the only
    exchange. An id is the count plus the rows of the partitions before. What passes through the driver is one row count
    per partition.
    """
    columns = [order] if isinstance(order, str) else order
    dealt = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    counted = cut_lineage(dealt.withColumn("__counted", F.monotonically_increasing_id()))
    part = F.shiftright("__counted", _COUNTER_BITS).cast("int")
    place = F.col("__counted").bitwiseAND(F.lit((1 << _COUNTER_BITS) - 1))
    sizes = counted.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("size")).collect()
    offsets, before = [], start
    for number, size in sorted(tuple(row) for row in sizes):
        offsets.append((number, before))
        before += size
    known = rows.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    return (
        counted.withColumn("__part", part)
        .join(F.broadcast(known), "__part")
        .withColumn(id_column, F.col("__offset") + place + 1)
        .select(*rows.columns, id_column)
    )


def rank_places(rows: DataFrame, place: str, id_column: str, start: int = 0, width: int = BLOCK_WIDTH) -> DataFrame:
    """Adds ids start+1, start+2, ... in the order of `place`, a unique number up to the size of the table it is from.

    Places are dense already, so blocks of them do for ranks; one row per block passes through the window without key.
    """
    blocked = rows.withColumn("_block", arrival_block(place, width))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("__offset"))
    )
    within = F.row_number().over(Window.partitionBy("_block").orderBy(place))
    return (
        blocked.withColumn("_rank", within)
        .join(offsets, "_block")
        .withColumn(id_column, (F.lit(start) + F.col("__offset") + F.col("_rank")).cast("long"))
        .drop("_block", "_rank", "__offset")
    )


def max_id(table: DataFrame) -> int:
    """Highest id in use: one number, combined from the maxima of the map tasks."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
