"""Near-duplicates by SimHash, found by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of two blocks of 31 bits.
On a block the anchors are the codewords of the [31, 26] Hamming code. Its covering radius is 1: each value has an
anchor within one bit. So two values one bit apart meet at an anchor that lies within 1 + 1 = 2 bits of both. Each
fingerprint goes to every anchor within that distance, 1 or 16 per block, and is compared with those it meets there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadrank.llm.components import components
from leadrank.operators.key_filter import flag_any_key
from leadrank.session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK_BITS = 31
# Fingerprints at one anchor that a task compares at once; larger groups are dealt out in pairs of parts.
GROUP_LIMIT = 16_384
# Groups up to this size are compared all at once; larger ones node by node.
SMALL_GROUP = 16


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    last = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, last, 65_536):
        high = min(low + 65_536, last)
        spans = zip(starts[low:high].tolist(), stops[low + size - 1 : high + size - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, high - low)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << int(bit) for bit in np.flatnonzero(counts * 2 > last))
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(text) for text in texts], dtype="int64")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """XOR of the positions (from 1) of the bits set: 0 for a codeword, else the bit to flip for the nearest one."""
    found = np.zeros(values.shape, np.uint64)
    for position in range(1, BLOCK_BITS + 1):
        found ^= np.where((values >> np.uint64(position - 1)) & np.uint64(1), np.uint64(position), np.uint64(0))
    return found


def _flips() -> np.ndarray:
    """For each syndrome the masks that lead to the codewords within two bits; row 0 has one, the others 16."""
    rows = [[0] * 16]
    for syndrome in range(1, BLOCK_BITS + 1):
        pairs = [(i, i ^ syndrome) for i in range(1, BLOCK_BITS + 1) if i < (i ^ syndrome)]
        rows.append([1 << (syndrome - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs])
    return np.array(rows, np.uint64)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of value, codeword) for every codeword within two bits of a 31-bit value."""
    syndromes = _syndromes(values)
    near = values[:, None] ^ _flips()[syndromes.astype(np.int64)]
    keep = np.ones(near.shape, bool)
    keep[syndromes == 0, 1:] = False
    index, column = np.nonzero(keep)
    return index, near[index, column]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for block in range(2):
            index, near = anchors((prints.view(np.uint64) >> np.uint64(block * BLOCK_BITS)) & mask)
            keys = near.astype(np.int64) | np.int64(block << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[index])], ["anchor", "fp"])


class _Forest:
    """Union-find that lets an edge pass only if it joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[up]
        return node

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _near(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS


def _links(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what is near within each run of equal keys; never more than one per row of large runs."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(keys))  # rows of the run from here on
    for step in range(1, SMALL_GROUP):
        at = np.flatnonzero(small & (left > step))
        if not len(at):
            break
        hit = at[_near(prints[at], prints[at + step])]
        yield from zip(prints[hit].tolist(), prints[hit + step].tolist())
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        rest = prints[start : start + size]
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                node = reached.pop()
                close = _near(rest, node)
                if close.any():
                    found, rest = rest[close], rest[~close]
                    yield from ((int(node), other) for other in found.tolist())
                    reached.extend(found)


def _compare(limit: int | None):
    """Links within the runs of rows sorted by anchor. Rows of runs beyond `limit` pass through with their anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        kept_keys = kept = np.empty(0, np.int64)
        over = None  # the anchor whose rows pass through

        def output(rows: list[tuple[int, int]], anchor: np.ndarray | None = None, prints: np.ndarray | None = None):
            u, v = ([r[0] for r in rows], [r[1] for r in rows]) if anchor is None else (prints, prints)
            keys = pa.nulls(len(rows), pa.int64()) if anchor is None else pa.array(anchor)
            arrays = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), keys]
            return pa.RecordBatch.from_arrays(arrays, ["u", "v", "over"])

        def finish(keys: np.ndarray, prints: np.ndarray):
            return output([pair for pair in _links(keys, prints) if forest.joins(*pair)])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            keys, prints = np.concatenate((kept_keys, keys)), np.concatenate((kept, prints))
            if over is not None:
                same = keys == over
                if same.any():
                    yield output([], keys[same], prints[same])
                    keys, prints = keys[~same], prints[~same]
            if not len(keys):
                kept_keys = kept = np.empty(0, np.int64)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if cut:
                yield finish(keys[:cut], prints[:cut])
            kept_keys, kept = keys[cut:], prints[cut:]
            if limit and len(kept) > limit:
                over = kept_keys[0]
                yield output([], kept_keys, kept)
                kept_keys = kept = np.empty(0, np.int64)
        if len(kept):
            yield finish(kept_keys, kept)

    return compare


def links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges `u`, `v` between distinct fingerprints `fp` that connect all within `MAX_BITS` bits of each other.

    An anchor with more than `group_limit` fingerprints is split: its rows are dealt into parts, and each pair of
    parts is a group of its own, so that memory stays bounded and no pair is lost.
    """
    met = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    schema = "u long, v long, over long"
    sorted_rows = met.repartition("anchor").sortWithinPartitions("anchor")
    found = cut_lineage(sorted_rows.mapInArrow(_compare(group_limit), schema))
    edges, over = found.where("over is null"), found.where("over is not null")
    if not over.isEmpty():
        parts = over.groupBy("over").agg(F.ceil(F.count("*") / group_limit).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = (
            over.join(parts, "over")
            .withColumn("own", own)
            .withColumn("other", other)
            .select(F.xxhash64("over", F.least("own", "other"), F.greatest("own", "other")).alias("anchor"), F.col("u").alias("fp"))
        )
        rows = dealt.repartition("anchor").sortWithinPartitions("anchor")
        edges = edges.union(rows.mapInArrow(_compare(None), schema))
    return edges.select("u", "v")


def classes(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """`fp`, `first_id` per distinct fingerprint in; out `fp`, `component_id`, the smallest id of its component."""
    stars = components(links(prints, group_limit))
    rooted = prints.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def simhash_components(
    docs: DataFrame, text: str = "text", key: str = "doc_id", group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per row of `docs`: the key, its `fingerprint` in hex, and `component_id`, the smallest key that can be
    reached over fingerprints that differ in at most three bits.

    * A-Z fold to lower case; words are cut at ASCII white space; shingles have three words, fewer words make one.
    * Null, empty and blank texts have fingerprint zero and link like any other.
    * Rows equal in text share fingerprint and component. A null key never names a component unless all of its keys
      are null. An empty table gives an empty one; other columns are not looked at.
    """
    rows = cut_lineage(docs.select(F.col(key).alias("doc_id"), fingerprints(text).alias("fp")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = cut_lineage(classes(prints, group_limit))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, "fp").select(F.col("doc_id").alias(key), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str, fp: Column, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`docs` with one row of each class; `find` turns distinct `fp`, `first_id` into `fp`, `component_id`."""
    names = docs.columns
    content = F.xxhash64(*[F.col(f"`{name}`").cast("string") for name in names])
    rank = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), content.alias("content"))
    rows = cut_lineage(docs.select(fp.alias("fp"), rank.alias("rank")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("rank").alias("first_id"), F.count("*").alias("rows")))
    chosen = cut_lineage(find(prints.select("fp", "first_id")).select(F.col("component_id").alias("rank")).distinct())
    copies = cut_lineage(rows.join(chosen, "rank").groupBy("rank").agg(F.count("*").alias("copies")))
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    # Only rows that may go, or may be there twice, are shuffled; a filter lets all others pass where they are scanned.
    settled = copies.where("copies = 1")
    doubtful = cut_lineage(rows.select("rank").distinct().join(settled, "rank", "left_anti"))
    marked = flag_any_key(docs.select(row.alias("row"), rank.alias("rank")), doubtful, {"rank": "rank"}, "doubtful")
    columns = [F.col(f"row.`{name}`") for name in names]
    asked = marked.where("doubtful").join(copies, "rank")
    kept = marked.where("not doubtful").select(*columns).union(asked.where("copies = 1").select(*columns))
    if copies.where("copies > 1").isEmpty():
        return kept
    return kept.union(asked.where("copies > 1").select(*columns).dropDuplicates())


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """`docs` with one row of each component of near-duplicates: the one with the smallest key, nulls last.

    Rows that tie on the key are told apart by a hash of all their columns; of rows equal in every column one stays.
    """
    return one_of_each(docs, key, fingerprints(text), lambda prints: classes(prints, group_limit))
