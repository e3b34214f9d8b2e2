import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadrank.llm import line_dedup
from tests.llm.samples import awkward, nothing

UPPER = {n: n + 32 for n in range(65, 91)}


def plain(rows, least_chars, least_docs):
    """(n_lines, n_dropped, kept text) of each (key, text), line by line."""
    holders = defaultdict(set)
    name = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for key, text in rows:
        for line in (text or "").split("\n"):
            holders[name(line)].add(key)
    order = lambda key: (key is not None, key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        stays = [
            line for line in lines
            if len(name(line)) < least_chars or len(holders[name(line)]) < least_docs or max(holders[name(line)], key=order) == key
        ]
        out.append((key, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def found(docs, **bounds):
    rows = line_dedup.deduplicated(docs, **bounds).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, rows), key=repr)


def test_equals_the_plain_rule(spark):
    rng = random.Random(3)
    common = ["Ünï line %d" % n for n in range(12)] + ["", "short", "  Padded Line \t", "padded line", "\x0bPADDED LINE\r", "日本語の行です🙂"]
    rows = [(n, "\n".join(rng.choices(common, k=rng.randrange(9)))) for n in range(60)]
    rows += [(60, "\n" * 5), (61, "\n".join(common * 40)), (7, "padded line\nx"), (7, None), (None, "padded line"), (None, common[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least_chars, least_docs in ((8, 5), (1, 2), (0, 3), (8, 20)):
        expected = sorted(plain(rows, least_chars, least_docs), key=repr)
        assert found(docs, least_chars=least_chars, least_docs=least_docs) == expected


def test_production_bounds(spark):
    line = "x" * 39
    rows = [(n, f"{line}\n {line}Y \nown {n}") for n in range(5)] + [(9, f"{line}Z")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == sorted(plain(rows, 40, 5), key=repr)
    assert sum(r[2] for r in found(docs)) == 4


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as place", "2 as gone", "3 as unit", "'x' as kept_text", "'y' as `a.b`")
    out = line_dedup.deduplicated(docs)
    assert out.columns == [c for c in docs.columns if c != "kept_text"] + ["n_lines", "n_dropped", "kept_text"]
    assert found(docs) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()], 40, 5), key=repr)
    assert line_dedup.deduplicated(nothing(spark)).count() == 0


@pytest.mark.parametrize("copies", [3000])
def test_a_line_of_all_documents_is_spread(spark, copies):
    """No task gathers the documents of a line: only counts and single places are grouped."""
    docs = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit("the very same line in each and every document").alias("text"))
    out = line_dedup.deduplicated(docs)
    assert out.where("n_dropped = 0").select("doc_id").first().doc_id == copies - 1
    assert out.agg(F.sum("n_dropped")).first()[0] == copies - 1
