"""Lookups that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more rows than this is spread; it takes one salt for every so many rows. At most one key per so many
# rows can be hot, so the list of hot keys stays short enough to be broadcast: 100,000 entries for 10**11 rows.
HOT_ROWS = 1_000_000


def salted_lookup(
    rows: DataFrame, entries: DataFrame, keys: list[str], unique: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of `rows` with `entries`, which has one row per key and `key_rows`, the rows it will meet.

    Rows of a hot key are dealt out by a hash of their `unique` column; the one entry of the key is repeated
    for each salt. Results do not depend on which keys are hot.
    """
    salts = F.ceil(F.col("key_rows") / hot_rows).cast("int")
    hot = entries.where(F.col("key_rows") > hot_rows).select(*keys, salts.alias("_salts"))
    salt = F.pmod(F.xxhash64(unique), F.col("_salts")).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = entries.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every))
    return (
        dealt.drop("_salts")
        .join(repeated.drop("_salts", "key_rows"), [*keys, "_salt"], "left")
        .drop("_salt")
    )
