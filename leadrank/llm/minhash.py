"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle of five words is hashed once. The top bits of the hash choose a bin, which keeps its smallest hash. An empty
bin borrows from the first bin that holds something in a fixed random order of its own (optimal densification).
The low-order bits of the bins, packed, are the fingerprint. Two fingerprints that agree in a share p of their bins are
(p - c) / (1 - c) alike, where c is the chance that b bits agree by accident.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.session import cut_lineage

SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
KEPT_BITS = 8
# Rows of neighbouring keys that are brought together to find each row's next one.
GROUP_ROWS = 4000
MAX_BOUNDS = 256


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _donors() -> Column:
    """For each bin, one after the other, all bins in a random order, derived from a hash."""
    order = []
    for place in range(BINS):
        order += sorted(range(BINS), key=lambda other: hashlib.sha256(f"{place}/{other}".encode()).digest())
    return F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>")


def bins(text: Column) -> Column:
    """The low-order bits of every bin, as an array; empty for a text without words.

    Words are cut at ASCII white space; fewer words than a shingle has make one shingle.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return _let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<tinyint>")).otherwise(_filled(_lowest(_hashes(w)))))


def _hashes(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(SHINGLE_WORDS)]))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS).cast("int")


def _lowest(hashes: Column) -> Column:
    """The smallest hash of each bin: where the bin changes along the sorted hashes."""
    return _let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))),
    )


def _filled(lowest: Column) -> Column:
    held = F.struct(F.transform(lowest, _bin).alias("bins"), lowest.alias("hashes"))

    def value(kept: Column, place: Column) -> Column:
        donor = F.get(F.array_intersect(F.slice(_donors(), place * BINS + 1, BINS), kept["bins"]), F.lit(0))
        return F.coalesce(F.try_element_at(kept["by_bin"], place), F.try_element_at(kept["by_bin"], donor))

    mapped = _let(held, lambda h: F.struct(h["bins"].alias("bins"), F.map_from_arrays(h["bins"], h["hashes"]).alias("by_bin")))
    places = F.sequence(F.lit(0), F.lit(BINS - 1))
    low = lambda x: F.shiftright(F.shiftleft(x, 64 - KEPT_BITS), 64 - KEPT_BITS).cast("tinyint")
    return _let(mapped, lambda kept: F.transform(places, lambda place: low(value(kept, place))))


def packed(bin_values: Column) -> Column:
    """Two hex digits per bin, in the order of the bins; empty for a text without words."""
    return F.array_join(F.transform(bin_values, lambda v: F.lower(F.lpad(F.hex(F.pmod(v.cast("int"), F.lit(256))), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; two texts without words are alike, one is unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    chance = 1.0 / (1 << KEPT_BITS)
    estimate = (same / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def with_next(docs: DataFrame, key: str, text: str, payload: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """`docs` with `next_<name>` for each name of `payload`, taken from the row with the next larger key; the last row
    takes the first one's. Null keys come last; rows of one key follow each other by a hash of their text.

    Rows are dealt into groups of neighbouring keys along quantiles of the key; the first row of each group also goes to
    the group before. So no task sees more than a group, whatever the keys look like.
    """
    tie = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 12)) / F.lit(float(1 << 12))
    narrow = cut_lineage(docs.select(F.col(key).cast("long").alias("id"), tie.alias("tie")))
    count, least, most = narrow.agg(F.count("*"), F.min("id"), F.max("id")).first()
    least, most = (0, 0) if least is None else (least, most)

    def placed(df: DataFrame, id_: Column, tie_: Column) -> DataFrame:
        """Adds the group, `range_no` and `part_no`, both in the order of the keys."""
        at = F.coalesce(id_.cast("double"), F.lit(float(most + 1))) + tie_
        df = df.withColumn("place", at)
        passed = F.filter(F.array(*[F.lit(edge) for edge in edges[:-1]]), lambda edge: edge <= F.col("place"))
        df = df.withColumn("range_no", F.greatest(F.size(passed) - 1, F.lit(0)))
        low, high = (F.get(F.array(*[F.lit(edge) for edge in edges]), F.col("range_no") + n) for n in (0, 1))
        part = F.floor((F.col("place") - low) / F.greatest(high - low, F.lit(1e-9)) * parts)
        return df.withColumn("part_no", F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)).cast("int"))

    ranges = max(1, min(MAX_BOUNDS, -(-count // group_rows)))
    parts = max(1, -(-count // (ranges * group_rows)))
    edges = [float(least), float(most + 2)]
    if ranges > 1:
        places = narrow.select((F.coalesce(F.col("id").cast("double"), F.lit(float(most + 1))) + F.col("tie")).alias("place"))
        cuts = places.approxQuantile("place", [n / ranges for n in range(1, ranges)], 0.2 / ranges)
        edges = sorted({edges[0], *cuts, edges[1]})
    rank = lambda id_, tie_: F.struct(id_.isNull().alias("last"), id_.alias("id"), tie_.alias("tie"))
    firsts = placed(narrow, F.col("id"), F.col("tie")).groupBy("range_no", "part_no").agg(
        F.min(rank(F.col("id"), F.col("tie"))).alias("first_rank")
    )
    firsts = cut_lineage(firsts)
    # The group before: in the same range, or the last one of the range before; the first group's is the last of all.
    ends = firsts.groupBy("range_no").agg(F.max("part_no").alias("end_part"))
    whole = Window.orderBy("range_no")  # one row per range
    last = F.struct("range_no", "end_part")
    before = ends.select(
        "range_no",
        F.coalesce(F.lag(last).over(whole), F.last(last).over(whole.rowsBetween(0, Window.unboundedFollowing))).alias("range_end"),
    )
    inside = Window.partitionBy("range_no").orderBy("part_no")
    own = F.lag("part_no").over(inside)
    firsts = firsts.join(before, "range_no").select(
        "range_no",
        "part_no",
        "first_rank",
        F.when(own.isNotNull(), F.col("range_no")).otherwise(F.col("range_end.range_no")).alias("range_before"),
        F.coalesce(own, F.col("range_end.end_part")).alias("part_before"),
    )
    firsts = cut_lineage(firsts)
    rows = placed(docs.withColumn("tie", tie), F.col(key).cast("long"), F.col("tie")).join(firsts, ["range_no", "part_no"])
    here = F.struct(F.col("range_no").alias("range_no"), F.col("part_no").alias("part_no"), F.lit(False).alias("copy"))
    there = F.struct(F.col("range_before").alias("range_no"), F.col("part_before").alias("part_no"), F.lit(True).alias("copy"))
    is_first = rank(F.col(key).cast("long"), F.col("tie")) == F.col("first_rank")
    goes = F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))
    dealt = rows.select(*docs.columns, "tie", goes.alias("group"))
    along = Window.partitionBy("group.range_no", "group.part_no").orderBy("group.copy", F.col(key).asc_nulls_last(), "tie")
    follow = [F.lead(name).over(along).alias(f"next_{name}") for name in payload]
    return dealt.select(*docs.columns, "group", *follow).where("not group.copy").drop("group")


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the key, `n_chars`, the packed `fingerprint`, that of the edited text with the text's
    `edited_sha256`, and how alike the fingerprint is to the edited text's and to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document, by ascending key; after the last comes the first.

    * Null counts as empty; texts without words have an empty fingerprint, alike to each other and to nothing else.
    * Equal texts have equal fingerprints. A single document follows itself. Rows of one key are ordered by a hash of
      their text, null keys come last. An empty table gives an empty one; other columns are not looked at.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = with_next(own.withColumn("bins", bins(F.col("text"))), "doc_id", "text", ["text", "bins"])
    length = F.char_length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring("text", 1, length - quarter), F.substring("next_text", 1, quarter))
    rows = marked.withColumn("edited", edited).withColumn("edited_bins", bins(F.col("edited")))
    return rows.select(
        F.col("doc_id").alias(key),
        length.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
