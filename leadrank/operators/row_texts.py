"""Long texts kept as ordered rows, cut into pieces without the text ever being one value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from leadrank.operators.ids import arrival_block, assign_ids
from leadrank.session import cut_lineage

# Rows of a text that are worked on together.
BLOCK_ROWS = 1 << 14


def _low_surrogates(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    return np.append((units & 0xFC00) == 0xDC00, False)


def passage(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block does to the open piece: for each number of units that it may hold on entry, from 0 to `limit` - 1, the
    pieces closed inside the block and the units that the open piece holds at its end.

    A piece closes after `limit` units, or one earlier where a character of two units would be parted.
    """
    low = _low_surrogates(text)
    length = len(low) - 1
    start, closed = -np.arange(limit, dtype=np.int32), np.zeros(limit, dtype=np.int32)
    while (open_ := start + limit <= length).any():
        end = start[open_] + limit
        start[open_] = end - low[end]
        closed[open_] += 1
    return closed, length - start


def fragments(text: str, limit: int, used: int) -> list[tuple[int, str]]:
    """The block cut at its piece boundaries, with the pieces closed before; the open piece held `used` units on entry."""
    low = _low_surrogates(text)
    data = text.encode("utf-16-le", "surrogatepass")
    length, start, cut, number, found = len(low) - 1, -used, 0, 0, []
    while cut < length:
        end = min(start + limit, length)
        end -= low[end]
        if end > cut:
            found.append((number, data[2 * cut : 2 * end].decode("utf-16-le", "surrogatepass")))
        start = cut = end
        number += 1
    return found


def split_rows(
    parts: DataFrame, order: list[str], limit: int, key: str = "run_id", text: str = "text", width: int = BLOCK_ROWS
) -> DataFrame:
    """Rows (key, chunk_no, chunk): the pieces of at most `limit` UTF-16 units of the texts of a key, joined in `order`.

    The pieces are those of cutting the joined text, which is never formed. Rows get their places by one range exchange and
    meet in blocks of at most `width`. Each block becomes a function from the fill of the open piece on entry to that at
    its end; one pass over these functions, a row per block, tells every block where it starts. Blocks then cut
    themselves, and the fragments of a piece, which are never more than it has units, are joined.

    Null and empty texts add nothing, a key without any other has no piece. Rows that tie in `order` follow their text.
    A key is never null.
    """
    if limit < 2:
        raise ValueError("a character can take two units")
    named = parts.select(F.col(key).alias("__key"), F.struct(*order).alias("__order"), F.col(text).alias("__text"))
    placed = assign_ids(named.where(F.length("__text") > 0), ["__key", "__order", "__text"], "__place", -1)
    in_order = F.array_sort(F.collect_list(F.struct("__place", "__text")))
    blocks = cut_lineage(
        placed.groupBy("__key", arrival_block("__place", width).alias("__block")).agg(
            F.array_join(F.transform(in_order, lambda row: row["__text"]), "").alias("__text"),
            (F.min("__place") % width == 0).alias("__opens"),
            (F.max("__place") % width == width - 1).alias("__closes"),
        )
    )

    @F.pandas_udf("closed array<int>, used array<int>")
    def passages(texts: pd.Series) -> pd.DataFrame:
        made = [passage(value, limit) for value in texts]
        return pd.DataFrame({"closed": [one[0] for one in made], "used": [one[1] for one in made]})

    schema = T.StructType(
        [blocks.schema["__key"], blocks.schema["__block"], T.StructField("__first", T.LongType()), T.StructField("__used", T.IntegerType())]
    )

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, first, used = object(), 0, 0
        for batch in batches:
            made = []
            for name, closed, left in zip(batch["__key"], batch["__closed"], batch["__left"]):
                if name != current:
                    current, first, used = name, 0, 0
                made.append((first, used))
                first, used = first + int(closed[used]), int(left[used])
            entered = pd.DataFrame(made, columns=["__first", "__used"], index=batch.index)
            yield pd.concat([batch[["__key", "__block"]], entered], axis=1)

    # A text of several blocks has all of them at an edge; of other texts that is true of two in a block at most.
    several = blocks.where("__opens or __closes")
    functions = several.select("__key", "__block", passages("__text").alias("__passage")).select(
        "__key", "__block", F.col("__passage.closed").alias("__closed"), F.col("__passage.used").alias("__left")
    )
    entered = functions.repartition("__key").sortWithinPartitions("__key", "__block").mapInPandas(entries, schema)

    @F.pandas_udf("array<struct<number:bigint,piece:string>>")
    def cut(texts: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([fragments(value, limit, start) for value, start in zip(texts, used)])

    start = F.coalesce("__used", F.lit(0))
    pieces = blocks.join(entered, ["__key", "__block"], "left").select(
        "__key", "__block", F.coalesce("__first", F.lit(0)).alias("__first"), F.explode(cut("__text", start)).alias("__cut")
    )
    whole = F.array_sort(F.collect_list(F.struct("__block", F.col("__cut.piece").alias("piece"))))
    return pieces.groupBy("__key", (F.col("__first") + F.col("__cut.number")).alias("chunk_no")).agg(
        F.array_join(F.transform(whole, lambda row: row["piece"]), "").alias("chunk")
    ).withColumnRenamed("__key", key)
