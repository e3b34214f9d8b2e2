"""Collocations by prefix-free parsing.

Every text is cut into chunks where the text itself says so: at windows of three tokens whose hash is a multiple of
`PERIOD`. Neighbouring chunks share the window, so any four words in a row lie within one of them, and a phrase belongs to
the chunk that holds its first word outside the shared end. Equal passages give equal chunks, wherever they stand. The
chunks form a dictionary with the frequency of each; phrases are counted inside the distinct chunks, weighted by it.

Phrases are counted by length. A longer one is looked at only where a filter of the frequent phrases one word shorter
lets both of its parts pass. The filter has at most 2**MAX_FILTER_BITS bits and only spares work: counts decide.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from leadrank.session import cut_lineage

LONGEST = 4
SHARED = LONGEST - 1
PERIOD = 32
LEAST_COUNT = 30
COVERED = 80  # percent of a phrase's occurrences that lie inside one longer phrase
SCALE = 2_000_000
TOP = 2_000
MAX_FILTER_BITS = 27
CACHED_WORDS = 500_000
GATHERED_BYTES = 4_000_000
MIXER = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)

# Separators become one token that no word can equal; white space within a piece is left to bytes.split().
BREAK = b"."
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_FOLD = bytes.maketrans(_UPPER + SEPARATORS, _LOWER + BREAK * len(SEPARATORS))
_BREAKS = re.compile(rb"\.[. \t]*")


def spelled(text: str | None) -> bytes:
    """The tokens of a text, joined by blanks: its words, with A-Z in lower case, and a BREAK wherever a piece ends."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return b" ".join(_BREAKS.sub(b" . ", folded).split())


class Hashes(dict):
    """Hash of a token, remembered."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def chunks(joined: bytes, period: int = PERIOD) -> Iterator[bytes]:
    """The chunks of joined tokens. The end is padded with breaks, so that each chunk owns all but its last SHARED tokens.

    For finding cuts a token counts by the sum of its letters' random numbers.
    """
    if not joined:
        return
    padded = joined + (b" " + BREAK) * SHARED
    letters = np.frombuffer(padded, np.uint8)
    opens = np.concatenate(([0], np.flatnonzero(letters == ord(" ")) + 1))
    each, count = np.add.reduceat(_LETTERS[letters], opens), len(opens) - SHARED
    window = each[:count]
    for step in range(1, SHARED):
        window = (window ^ (window >> np.uint64(29))) * MIXER + each[step : step + count]
    cuts = np.flatnonzero(((window * MIXER) >> np.uint64(32)) % np.uint64(period) == 0)
    starts = [0, *cuts[cuts > 0].tolist(), count]
    edges = [*opens.tolist(), len(padded) + 1]
    for start, stop in zip(starts, starts[1:]):
        yield padded[edges[start] : edges[stop + SHARED] - 1]


def _parse(period: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                languages, parsed = [], []
                for language, text in zip(part.column(0).to_pylist(), part.column(1)):
                    mine = list(chunks(spelled(text.as_py()), period))
                    parsed += mine
                    languages += [language] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(parsed, pa.binary())], ["lang", "chunk"])

    return parse


def parse(docs: DataFrame, text: str = "text", lang: str = "lang", period: int = PERIOD) -> DataFrame:
    """The dictionary: `lang`, `chunk`, `weight`, the number of times that the chunk occurs in texts of the language."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parsed = rows.mapInArrow(_parse(period), "lang string, chunk binary")
    return parsed.groupBy("lang", "chunk").agg(F.count("*").alias("weight"))


def phrase_hashes(languages: np.ndarray, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the phrase of `size` words at each place `at`, by the hashes of language and words at all places."""
    mixed = languages[at]
    for step in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ words[at + step]) * MIXER
    return mixed


class Filter:
    """A bit for the hash of each frequent phrase."""

    def __init__(self, words, bits: int) -> None:
        self.words, self.bits = words, bits

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - self.bits)
        found = self.words.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))
        return (found & np.uint64(1)).astype(bool)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        out = np.empty(batch.num_rows, np.uint64)
        for row, (language, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            words = hashes.of(phrase.split(b" "))
            out[row] = phrase_hashes(hashes.of([language.encode()]), words, np.zeros(1, np.int64), len(words))[0]
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["hash"])


def frequent_filter(frequent: DataFrame) -> Filter:
    """A filter of at most 2**MAX_FILTER_BITS bits; Spark builds its words, of which the driver joins so many at most."""
    bits = min(MAX_FILTER_BITS, max(10, (256 * frequent.count()).bit_length()))
    hashes = frequent.select("lang", "phrase").mapInArrow(_hashed, "hash long")
    bit = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit"))
    word = F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word")
    rows = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(word).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return Filter(frequent.sparkSession.sparkContext.broadcast(words), bits)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about GATHERED_BYTES of chunks at once, so that more of what repeats is summed before it is shuffled."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= GATHERED_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counter(size: int, shorter: Filter | None):
    """Phrases of `size` words in the chunks that a task gathers, with their weighted counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for rows in _gathered(batches):
            split = pc.split_pattern(rows.column(1).combine_chunks().cast(pa.string()), " ")
            lengths = pc.list_value_length(split).to_numpy()
            found = split.flatten().dictionary_encode()
            code, words = found.indices.to_numpy().astype(np.int64), found.dictionary
            spoken = rows.column(0).combine_chunks().dictionary_encode()
            known = spoken.dictionary
            language = np.repeat(spoken.indices.to_numpy().astype(np.int64), lengths)
            weight = np.repeat(rows.column(2).to_numpy(), lengths)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # tokens of the chunk from here on
            word = code != pc.index(words, BREAK.decode()).as_py()
            at = np.flatnonzero(left > SHARED)
            for step in range(size):
                at = at[word[at + step]]
            if shorter is not None:
                hashed = hashes.of(words.cast(pa.binary()).to_pylist())[code]
                speech = hashes.of(known.cast(pa.binary()).to_pylist())[language]
                for step in range(2):
                    at = at[shorter.passes(phrase_hashes(speech, hashed, at + step, size - 1))]
            key, keys = language[at], len(known)
            for step in range(size):
                if keys * len(words) >= 1 << 62:
                    key = np.unique(key, return_inverse=True)[1]
                    keys = len(at)
                key, keys = key * len(words) + code[at + step], keys * len(words)
            order = np.argsort(key, kind="stable")
            opens = np.flatnonzero(np.diff(key[order], prepend=-1))
            first = at[order[opens]]
            sums = np.add.reduceat(weight[at[order]], opens) if len(opens) else np.empty(0, np.int64)
            parts = [words.take(pa.array(code[first + step])) for step in range(size)]
            phrase = pc.binary_join_element_wise(*parts, " ").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([known.take(pa.array(language[first])), phrase, pa.array(sums)], ["lang", "phrase", "count"])

    return count


def counted(dictionary: DataFrame, size: int, shorter: Filter | None = None) -> DataFrame:
    """`lang`, `phrase`, `count` of the phrases of `size` words; `shorter` may spare those with rare parts."""
    rows = dictionary.select("lang", "chunk", "weight")
    found = rows.mapInArrow(_counter(size, shorter), "lang string, phrase binary, count long")
    return found.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST_COUNT,
    top: int = TOP,
    period: int = PERIOD,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    * Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs; A-Z fold.
    * `a` counts a phrase of two to four words, within pieces, overlaps included; those under `least` are left out. `l` and
      `r` count its two parts at the cut with the lowest score, floor(SCALE * a / (l + r)), the first one of equals.
    * A phrase goes if COVERED percent of it lie inside one longer phrase. Such a one is a word longer at most: any part
      of it that holds the phrase is as frequent.
    * `n` counts all words of the language. Null languages are `und`, null and empty texts have no words. Equal rows count
      each. An empty table gives an empty result; other columns are not looked at.

    A chunk is never longer than its text; a task holds the tokens of one batch of chunks. Frequent words and passages
    combine in the map tasks.
    """
    dictionary = cut_lineage(parse(docs, text, lang, period))
    words = cut_lineage(counted(dictionary, 1))
    levels = [words.where(F.col("count") >= least)]
    for size in range(2, LONGEST + 1):
        shorter = frequent_filter(levels[-1])
        levels.append(cut_lineage(counted(dictionary, size, shorter).where(F.col("count") >= least)))
    phrases = [
        level.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("count").alias("a"), F.lit(size).alias("size"))
        for size, level in enumerate(levels, 1)
    ]
    counts = cut_lineage(reduce(DataFrame.union, phrases))
    scored = _lowest_cut(counts.where("size > 1"), counts)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = _uncovered(scored, counts).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("count").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _lowest_cut(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `l`, `r`, `score` of the cut that scores lowest."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns(
        {
            "first": F.expr("substring_index(phrase, ' ', k)"),
            "rest": F.expr("substring_index(phrase, ' ', k - size)"),
        }
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = "decimal(19, 0)"
    score = F.expr(f"cast({SCALE} as {wide}) * cast(a as {wide}) div (cast(l as {wide}) + cast(r as {wide}))")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    lowest = joined.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "size", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, counts: DataFrame) -> DataFrame:
    ends = [F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")]
    inner = counts.where("size > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = "decimal(19, 0)"
    covered = F.lit(100) * F.col("most").cast(wide) >= F.lit(COVERED) * F.col("a").cast(wide)
    return scored.join(most, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
