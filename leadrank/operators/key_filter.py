"""A filter of keys, small enough for every task, that thins out a large table before any of it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadrank.session import cut_lineage

# The filter has at most 2**MAX_BITS bits, in at most 2**(MAX_BITS - 6) rows of one word, 4 MB in all, whatever the number
# of keys. With more keys it lets more rows pass; the joins behind it decide.
MAX_BITS = 24
BITS_PER_KEY = 64
_MIXES = (17, 40)  # two bits per key, taken from different parts of its hash


def _bits(key: Column, size: int) -> list[Column]:
    hashed = F.xxhash64(key)
    return [F.shiftrightunsigned(hashed, mix).bitwiseAND(F.lit((1 << size) - 1)) for mix in _MIXES]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def filter_size(keys: int) -> int:
    return min(MAX_BITS, max(10, (BITS_PER_KEY * keys).bit_length()))


def key_words(keys: DataFrame, column: str, size: int) -> DataFrame:
    """The words of the filter: `at` and `word`, one row per word with a bit set."""
    bit = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_bits(F.col(column), size))).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(_one(F.col("bit"))).alias("word"))


def flag_any_key(rows: DataFrame, keys: DataFrame, columns: dict[str, str], flag: str) -> DataFrame:
    """Adds `flag`, whether some column may hold a key: true of all rows that do, and of a few that do not.

    `columns` maps columns of `rows` to columns of `keys`. Rows meet the words of the filters in broadcast joins, so they
    are told apart where they are scanned.
    """
    size = filter_size(keys.count())
    names, met, hits = rows.columns, rows, []
    for n, (column, key) in enumerate(columns.items()):
        words = cut_lineage(key_words(keys, key, size))
        found = []
        for m, bit in enumerate(_bits(F.col(column), size)):
            at, word = f"_at_{n}_{m}", f"_word_{n}_{m}"
            side = F.broadcast(words.select(F.col("at").alias(at), F.col("word").alias(word)))
            met = met.join(side, F.shiftright(bit, 6) == F.col(at), "left")
            found.append(F.coalesce(F.col(word).bitwiseAND(_one(bit)) != 0, F.lit(False)))
        hits.append(F.col(column).isNotNull() & reduce(lambda a, b: a & b, found))
    return met.select(*names, reduce(lambda a, b: a | b, hits).alias(flag))


def with_any_key(rows: DataFrame, keys: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of which some column may hold a key, as `flag_any_key` tells: they are thinned out where they are scanned."""
    return flag_any_key(rows, keys, columns, "_may").where("_may").drop("_may")
