"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a hash of its content. The words of a source are summed per hash bucket; the running sum of the
buckets shows in which of them the budget of the source is used up. Only the rows of that boundary bucket are
summed again over finer buckets, until it holds one hash. The result is one threshold per source, and a filter takes
the rows below it. Nothing is sorted; thresholds are nested: a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.llm.common import WORD, without
from leadrank.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
HASH_BITS = 60
STEP_BITS = 10
COLUMNS = ["size", "source_size", "target", "taken"]


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds `size`, the number of words of the text (null: 0), and `mix_hash`, 60 bits of a hash of key and text."""
    content = F.concat(
        F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))
    )
    docs = docs.select(
        *[F.col(f"`{name}`") for name in without(docs, ["size", "mix_hash"]).columns],
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(content.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("mix_hash"),
    )
    return docs


def _source_key(source: str) -> Column:
    """A source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _bucket(level: int) -> Column:
    return F.shiftright("mix_hash", HASH_BITS - STEP_BITS * (level + 1))


def _histogram(units: DataFrame, level: int, keys: list[str]) -> DataFrame:
    return units.groupBy(*keys, _bucket(level).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("mix_hash").alias("low"), F.max("mix_hash").alias("high")
    )


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row per source in, one out, with its target.

    A source whose limit (`max_repeats` times its size) is small for its weight gets just that limit. In the order
    of limit per weight these come first, so that two running sums find them; the rest share what is left.
    The window has no key: it holds one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("source_no") % len(weights) + 1)
    everything = Window.partitionBy(F.lit(1))
    filled = (
        sizes.withColumn("source_no", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weights_on", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("fill", (F.col("budget") - F.col("caps_before")) / F.col("weights_on"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("fill"))
    )
    left = F.first("budget").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    level = F.try_divide(left, open_weight)
    return filled.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    ).select("source_key", "source_size", "target")


def thresholds(
    units: DataFrame,
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per source: `source_key`, `source_size`, `target`, whole `rounds`, and `upto`, the largest hash taken
    once more. `units` holds the source, `size` and `mix_hash` of each row and should be a written table: it is read
    once for the first histogram and once for each refinement."""
    units = units.select(F.col(source).alias("source"), _source_key(source).alias("source_key"), "size", "mix_hash")
    first = cut_lineage(_histogram(units, 0, ["source_key", "source"]))
    sizes = first.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    goals = _targets(sizes, weights, share, max_repeats)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    goals = goals.withColumn("rounds", F.least(whole, F.lit(max_repeats)).cast("long"))
    goals = cut_lineage(goals.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")))
    found = first.drop("source").join(goals, "source_key").withColumn("before", F.lit(0).cast("long"))
    for level in range(HASH_BITS // STEP_BITS):
        running = Window.partitionBy("source_key").orderBy("bucket")
        found = (
            found.withColumn("upto_words", F.col("before") + F.sum("words").over(running))
            .where((F.col("rest") > 0) & (F.col("upto_words") >= F.col("rest")))
            .withColumn("nth", F.row_number().over(running))
            .where("nth = 1")
            .withColumn("before", F.col("upto_words") - F.col("words"))
            .select(*goals.columns, "bucket", "before", "words", "low", "high")
        )
        found = cut_lineage(found)
        if level + 1 == HASH_BITS // STEP_BITS or found.where("low < high").isEmpty():
            break
        inside = units.withColumn("bucket", _bucket(level)).join(found.select(*goals.columns, "bucket", "before"), ["source_key", "bucket"])
        found = _histogram(inside.drop("bucket"), level + 1, [*goals.columns, "before"])
    # The boundary hash itself belongs to whichever side is nearer to the target.
    nearer = F.col("before") + F.col("words") - F.col("rest") <= F.col("rest") - F.col("before")
    edge = found.select("source_key", F.when(nearer, F.col("high")).otherwise(F.col("low") - 1).alias("upto"))
    return cut_lineage(
        goals.join(edge, "source_key", "left").select(
            "source_key", "source_size", "target", "rounds", F.coalesce("upto", F.lit(-1)).alias("upto")
        )
    )


def apply_thresholds(units: DataFrame, limits: DataFrame, source: str = "source") -> DataFrame:
    """Adds `source_size`, `target` and `taken`, the words that the mix takes of a row, repeats counted."""
    names = [name for name in without(units, COLUMNS[1:]).columns if name != "mix_hash"]
    copies = F.col("__mix_rounds") + F.when(F.col("mix_hash") <= F.col("__mix_upto"), 1).otherwise(0)
    limits = limits.select(*[F.col(name).alias(f"__mix_{name}") for name in limits.columns])
    rows = without(units, COLUMNS[1:]).withColumn("__mix_source_key", _source_key(source))
    return rows.join(limits, "__mix_source_key").select(
        *[F.col(f"`{name}`") for name in names],
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **settings) -> DataFrame:
    """All rows of `docs` with `size`, `source_size`, `target` and `taken` (0 for rows left out).

    * Sources in code-point order, null last, get the weights in turn and share `share` times all words. No target
      exceeds `max_repeats` times the source's words; the excess goes to the others by weight.
    * A target of a source takes every row as often as whole multiples of its size fit, and rows up to the threshold
      once more. Whole rows are taken, so a source misses its target by at most half the words of one row.
    * Null and empty texts have size 0 and are taken with 0 words. Rows equal in key and text share a hash and are
      taken or left together. An empty table gives an empty one.
    * Columns of the result replace columns of `docs` with the same name.
    """
    rows = measured(docs, text, key)
    limits = thresholds(cut_lineage(rows.select(source, "size", "mix_hash")), source, **settings)
    return apply_thresholds(rows, limits, source)
