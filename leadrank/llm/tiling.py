"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of five words (a seed) are joined. For each such pair the longest
matches between item and document are marked, again and again, without overlap, until none of five words is left;
so passages are found in any order. Matches are found by Karp-Rabin hashes of running windows and then compared word
by word. An item counts as leaked when the marked tiles cover at least 0.8 of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadrank.llm.common import text_key, without
from leadrank.session import cut_lineage

LEAST_WORDS = 5
COVERAGE = 0.8
FIRST_LENGTH = 20
# The filter of seeds that is sent to every task has at most 2**27 bits, 16 MB, however large the benchmark is;
# it only spares work, the join decides.
MAX_FILTER_BITS = 27
WORDS = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64
CACHED_WORDS = 500_000


class Coder:
    """Words of a text as numbers; a number per spelling, the same in every process."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").lower())
        codes = self.codes
        if len(codes) > CACHED_WORDS:
            codes.clear()
        for word in words:
            if word not in codes:
                raw = word.encode("utf-8", "surrogatepass")
                codes[word] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every window of `length` codes, modulo 2**64.

    Running sums give each window as a difference; a power of the inverse base brings it to a common place.
    """
    count = len(codes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(BASE, len(codes)))))
    return (sums[length:] - sums[:count]) * _powers(pow(BASE, -1, 1 << 64), count)


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(marked)))
    return run[length:] == run[:-length]


def _matches(item: np.ndarray, doc: np.ndarray, item_marked: np.ndarray, doc_marked: np.ndarray, length: int):
    """Left-maximal matches of unmarked words, at least `length` long, as (words, place in item, place in doc)."""
    if len(item) < length or len(doc) < length:
        return []
    item_hashes, doc_hashes = window_hashes(item, length), window_hashes(doc, length)
    places = defaultdict(list)
    for place in np.flatnonzero(_free_windows(item_marked, length)).tolist():
        places[int(item_hashes[place])].append(place)
    wanted = np.fromiter(places, np.uint64, len(places))
    found = []
    for d in np.flatnonzero(np.isin(doc_hashes, wanted) & _free_windows(doc_marked, length)).tolist():
        for i in places[int(doc_hashes[d])]:
            if i and d and item[i - 1] == doc[d - 1] and not item_marked[i - 1] and not doc_marked[d - 1]:
                continue  # part of a match that starts further left
            most = min(len(item) - i, len(doc) - d)
            stop = (item[i : i + most] != doc[d : d + most]) | item_marked[i : i + most] | doc_marked[d : d + most]
            words = int(stop.argmax()) if stop.any() else most
            if words >= length:
                found.append((words, i, d))
    return found


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (words, place in item, place in doc) of each tile, in the order of marking.

    Longest first; of equal ones the first in the item, then in the document. The search length starts above `least`,
    follows a match more than twice as long, and is halved when no match of that length is left.
    """
    item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    done: list[tuple[int, int, int]] = []
    length = max(least, FIRST_LENGTH)
    while True:
        found = _matches(item, doc, item_marked, doc_marked, length)
        longest = max((match[0] for match in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        while found:
            words, i, d = found.pop(found.index(min(found, key=lambda match: (-match[0], *match[1:]))))
            taken = item_marked[i : i + words] | doc_marked[d : d + words]
            if not taken.any():
                item_marked[i : i + words] = doc_marked[d : d + words] = True
                done.append((words, i, d))
                continue
            # What other tiles have left of the match may still be long enough.
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if stop - start >= length:
                    found.append((stop - start, i + start, d + start))
        if length == least:
            return done
        length = max(least, length // 2) if length <= 4 * FIRST_LENGTH else max(least, FIRST_LENGTH)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Coder()
    for batch in batches:
        keys, seeds, places, words = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = code(text)
            found, counts = np.unique(window_hashes(codes, LEAST_WORDS), return_counts=True)
            keys += [key] * len(found)
            seeds.append(found)
            places.append(counts)
            words += [len(codes)] * len(found)
        joined = np.concatenate([np.empty(0, np.uint64), *seeds]).view(np.int64)
        counts = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int64)
        arrays = [pa.array(keys, pa.string()), pa.array(joined), pa.array(counts), pa.array(words, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["item_key", "seed", "places", "words"])


def _seeded(seed_filter, bits: int, fewest: int):
    """Texts with at least `fewest` different seeds that the filter lets pass, and these seeds."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, words, shift = Coder(), seed_filter.value, np.uint64(64 - bits)
        for batch in batches:
            places, seeds = [], []
            for place, text in enumerate(batch.column(1)):
                hashes = window_hashes(code(text.as_py()), LEAST_WORDS)
                bit = hashes >> shift
                hit = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                found = np.unique(hashes[hit.astype(bool)])
                if len(found) >= fewest:
                    places.append(place)
                    seeds.append(found.view(np.int64))
            kept = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(seeds, pa.list_(pa.int64()))], ["doc_key", "doc_text", "seeds"]
            )

    return seeded


def _seed_filter(seeds: DataFrame):
    """A bit per seed, found by the top bits of its hash; built by Spark, at most 2**MAX_FILTER_BITS bits."""
    count = seeds.count()
    bits = min(MAX_FILTER_BITS, max(10, (1024 * count).bit_length()))
    place = F.shiftrightunsigned("seed", 64 - bits)
    word = F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))")
    rows = (
        seeds.select(place.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(word.alias("word"))
        .toArrow()
    )
    words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return seeds.sparkSession.sparkContext.broadcast(words), bits


def _tile_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    code = Coder()
    for batch in batches:
        rows = []
        for pair in batch.itertuples(index=False):
            item = code(pair.item_text)
            found = tiles(item, code(pair.doc_text))
            covered = sum(tile[0] for tile in found) / len(item)
            rows.append((pair.doc_key, pair.item_key, covered, len(found), max((t[0] for t in found), default=0)))
        yield pd.DataFrame(rows, columns=["doc_key", "item_key", "coverage", "tiles", "longest"])


def leaked_texts(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """`doc_key`, `item_key` (names of texts), `coverage`, `tiles`, `longest` for each pair of different texts in which
    the tiles cover at least `coverage` of the item.

    To reach it, an item of n words must have matches at coverage * n / 5 of its seeds at least; only such pairs are
    tiled, and a text with fewer different seeds than any item needs is passed over at once. Items with fewer than
    five words hold no seed and match nothing.
    """
    items = benchmark.select(text_key(item_text).alias("item_key"), F.col(item_text).alias("item_text")).distinct()
    seeds = cut_lineage(items.mapInArrow(_item_seeds, "item_key string, seed long, places long, words long"))
    need = F.ceil(F.col("words") * F.lit(coverage) / LEAST_WORDS)
    most_places = Window.partitionBy("item_key").orderBy(F.desc("places"), "seed")
    fewest = (
        seeds.withColumn("reached", F.sum("places").over(most_places.rowsBetween(Window.unboundedPreceding, 0)) >= need)
        .groupBy("item_key")
        .agg((F.count_if(~F.col("reached")) + 1).alias("seeds"))
        .agg(F.min("seeds"))
        .first()[0]
    )
    bitmap, bits = _seed_filter(seeds)
    keyed = docs.select(text_key(text).alias("doc_key"), F.col(text).alias("doc_text"))
    near = keyed.mapInArrow(_seeded(bitmap, bits, fewest or 1), "doc_key string, doc_text string, seeds array<long>")
    near = cut_lineage(near)
    hits = near.select("doc_key", F.explode("seeds").alias("seed")).distinct()
    pairs = cut_lineage(
        hits.join(seeds, "seed")
        .groupBy("doc_key", "item_key")
        .agg((F.sum("places") >= F.first(need)).alias("enough"))
        .where("enough")
        .drop("enough")
    )
    texts = (
        near.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi")
        .groupBy("doc_key")
        .agg(F.first("doc_text").alias("doc_text"))
    )
    tiled = (
        pairs.join(items, "item_key")
        .join(texts, "doc_key")
        .mapInPandas(_tile_pairs, "doc_key string, item_key string, coverage double, tiles long, longest long")
    )
    return cut_lineage(tiled.where(F.col("coverage") >= coverage))


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", **settings
) -> DataFrame:
    """One row per document and benchmark item leaked into it: both ids, `coverage`, `tiles`, `longest` tile in words.

    Words are runs of letters, digits and underscores in lower case; what stands between them does not matter.
    Null and empty texts match nothing. Repeated rows on either side each give a row; null ids are kept. An empty
    table on either side gives an empty one; other columns are not looked at.
    """
    found = leaked_texts(docs, benchmark, text, **settings)
    items = benchmark.select(text_key("text").alias("item_key"), F.col(item).alias("item_id"))
    rows = docs.select(text_key(text).alias("doc_key"), F.col(key).alias("doc_id"))
    named = rows.join(found.join(items, "item_key"), "doc_key")
    return named.select(F.col("doc_id").alias(key), F.col("item_id").alias(item), "coverage", "tiles", "longest")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """`docs` without the rows into whose text a benchmark item has leaked."""
    found = leaked_texts(docs, benchmark, text, **settings).select(F.col("doc_key").alias("__doc_key")).distinct()
    names = without(docs, ["__doc_key"]).columns
    return docs.withColumn("__doc_key", text_key(text)).join(found, "__doc_key", "left_anti").select(*names)
