import re

import pytest
from pyspark.sql import functions as F

from leadrank.llm import mixing
from tests.llm.samples import DDL, awkward, nothing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if target[s] >= most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: float(most * sizes[s]) for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, rows, slack):
    docs = spark.createDataFrame(rows, DDL)
    found = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + words(row[1])
    goal = shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    for row in found:
        assert row.target == pytest.approx(goal[row.source]) and row.source_size == sizes[row.source]
        assert row.taken in (0, row.size, 2 * row.size)
        taken[row.source] += row.taken
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= slack(source)


def test_awkward_rows(spark):
    from tests.llm.samples import AWKWARD

    check(spark, AWKWARD, lambda source: 100_000)
    assert mixing.mix(nothing(spark)).collect() == []


def test_each_source_meets_its_target_within_half_a_row(spark):
    rows = [(n, "w " * (1 + n * 7 % 23), "en", None if n % 11 == 0 else f"s{(n % 3) * (n % 5)}", 0) for n in range(3000)]
    check(spark, rows, lambda source: 12)


def test_columns_of_the_result_replace_others_and_reruns_agree(spark):
    docs = awkward(spark).withColumn("Size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("upto", F.lit(2))
    first, second = (mixing.mix(docs.repartition(n)).orderBy("doc_id", "text").collect() for n in (1, 5))
    assert first == second and "upto" in first[0].asDict() and len(first) == 9
    assert [name.lower() for name in first[0].asDict()].count("size") == 1


def test_smaller_budgets_are_nested(spark):
    docs = spark.createDataFrame([(n, "w " * (1 + n % 9), "en", f"s{n % 2}", 0) for n in range(800)], DDL)
    taken = [
        {row.doc_id for row in mixing.mix(docs, share=share).where("taken > 0").collect()} for share in (0.2, 0.4, 0.7)
    ]
    assert taken[0] < taken[1] < taken[2]
