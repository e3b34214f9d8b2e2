import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadrank.functions import records, scoring, text
from leadrank.functions.fixed import DIMENSION_WEIGHTS
from leadrank.functions.shape import text_problem
from leadrank.operators.validation import with_problem
from leadrank.plans import bindings
from tests.samples import evaluation, strategy


def column(spark, values, make):
    rows = spark.createDataFrame([(i, value) for i, value in enumerate(values)], "i int, v string")
    return [row.out for row in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_name(spark):
    names = ["株式会社 ABC", "ＡＢＣ株式会社", "株式 会社X", "㈱X（有）", "Straße　 GmbH", "a B\tc\x1fd", "", None]
    expected = ["abc", "abc", "株式会社x", "x", "strassegmbh", "abcd", "", None]
    assert column(spark, names, text.normalize_name) == expected
    assert list(text.fold_names(pd.Series(names[:-1]))) == expected[:-1]


def test_website_domain(spark):
    urls = [
        "https://www.www.ex.com./", "https://sub.ex.com", "HTTP://Me@WWW.Ex.com:8080/x", "https://[::1]:80/x",
        "https://a_b.com/p q", "https://www.", "", None,
    ]
    expected = ["www.ex.com", "sub.ex.com", "ex.com", "::1", "a_b.com", "www", None, None]
    assert column(spark, urls, text.website_domain) == expected


def test_canonical_url(spark):
    urls = [
        "HTTPS://User@EX.com:443/A?b=C#f", "https://ex.com?", "https://ex.com", "https://ex.com?a?", "http://ex.com#f",
        "https://ex.com/a b?x=", "https://ex.com/a?", "https://ex.com/?q=1?",
    ]
    expected = [
        "https://user@ex.com:443/A?b=C", "https://ex.com/", "https://ex.com/", "https://ex.com/?a?",
        "http://ex.com/", "https://ex.com/a b?x=", "https://ex.com/a", "https://ex.com/?q=1?",
    ]
    assert column(spark, urls, text.canonical_url) == expected
    ports = ["https://ex.com:443/a", "http://ex.com:80", "https://ex.com:80/", "http://ex.com/:80"]
    assert column(spark, ports, text.drop_default_port) == [
        "https://ex.com/a", "http://ex.com", "https://ex.com:80/", "http://ex.com/:80",
    ]


def test_fingerprint_without_date(spark):
    import hashlib

    key = "brand|新ブランド|None"
    rows = spark.createDataFrame([("brand", " 新ブランド")], "t string, n string")
    made = rows.select(text.trigger_fingerprint(F.col("t"), F.col("n"), F.lit(None).cast("date"))).first()[0]
    assert made == hashlib.sha256(key.encode()).hexdigest()


def test_redact_and_format(spark):
    assert column(spark, ["key-1 and hogehoge"], lambda c: text.redact(c, ["key-1", "", "hogehoge"])) == [
        "[REDACTED] and hogehoge"
    ]
    assert column(spark, ["100", "0", "86.5", "62.48"], lambda c: text.format_g(c.cast("double"))) == [
        "100", "0", "86.5", "62.48",
    ]


def totals(spark, dimensions, parity="sql"):
    columns = {name: F.lit(float(value)) for name, value in zip(DIMENSION_WEIGHTS, dimensions)}
    return spark.range(1).select(scoring.weighted_total(columns, parity)).first()[0]


@pytest.mark.parametrize("parity", ["sql", "python"])
def test_weighted_total(spark, parity):
    assert totals(spark, [10] * 6, parity) == 100
    assert totals(spark, [0] * 6, parity) == 0
    assert totals(spark, [9, 9, 8, 9, 7, 10], parity) == 86.5
    assert totals(spark, [11, -1, 11, 11, 11, 11], parity) == 80
    for value in ("nan", "inf", "-inf"):
        assert totals(spark, [value] + [5] * 5, parity) is None


def test_python_parity_rounds_the_binary_value(spark):
    assert totals(spark, [1.07, 0, 0, 0, 0, 0], "python") == round(1.07 * 2.5, 2)


def test_python_parity_on_many_totals_without_python(spark):
    made = spark.range(1_000_000).selectExpr(
        "CASE id % 4 WHEN 0 THEN rand(3) * 100 WHEN 1 THEN id % 80000 / 800e0 "
        "WHEN 2 THEN (id % 20000 + 0.5e0) / 200e0 ELSE id % 10001 / 100e0 + pow(2e0, -(id % 60)) END AS v"
    )
    found = made.withColumn("r", scoring.round_binary(F.col("v")))
    assert "Python" not in found._jdf.queryExecution().toString()
    rows = found.toPandas()
    assert (rows["r"].to_numpy() == [round(value, 2) for value in rows["v"].tolist()]).all()


def test_priority(spark):
    typed = F.from_json(F.lit(json.dumps(evaluation())), records.EVALUATION_DDL)
    zero = evaluation(deliver=dict.fromkeys(evaluation()["deliver"], 0))
    full = {stage: dict.fromkeys(evaluation()[stage], 10) for stage in ("need", "win", "deliver")}
    values = [evaluation(), zero, evaluation(**full)]
    made = column(
        spark,
        [json.dumps(value) for value in values],
        lambda c: scoring.evaluation_priority(F.from_json(c, records.EVALUATION_DDL)),
    )
    assert made == [round(10 * (8 * 5 * 5) ** (1 / 3), 2), 0.0, 100.0]
    assert typed is not None


def test_message_chunks():
    report = "日本語🙂" * 1600
    for limit in (2, 3, 1900):
        chunks = text.utf16_chunks(report, limit)
        assert "".join(chunks) == report
        assert all(len(chunk.encode("utf-16-le")) // 2 <= limit for chunk in chunks)
    assert text.utf16_chunks("", 5) == []
    # Greedy: a chunk is only shorter by one unit, where the next character takes two.
    assert [len(chunk.encode("utf-16-le")) // 2 for chunk in text.utf16_chunks("a🙂🙂b", 4)] == [3, 3]


def test_pieces_leave_in_small_batches():
    texts = ["ab🙂" * 500] * 1_000 + [None, "", "x" * 3_000_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    for limit in (100, 1_900):
        made = list(text.message_pieces(limit)(iter([rows])))
        assert max(batch.num_rows for batch in made) <= text.PIECES and len(made) > 3
        found = pa.Table.from_batches(made).to_pylist()
        wanted = [(n, i, c) for n, value in enumerate(texts) for i, c in enumerate(text.utf16_chunks(value or "", limit))]
        assert [(row["id"], row["chunk_no"], row["chunk"]) for row in found] == wanted


def candidate_cases(candidate):
    fact = {"topic": "sns", "fact": "f", "source_url": "https://x.example"}
    change = lambda **changes: {**candidate, **changes}
    without = {key: value for key, value in candidate.items() if key != "location"}
    return [
        candidate, change(website=None), change(published_at=None), change(discovered_at=None),
        change(research_facts=[fact] * 12, research_unknowns=["a"] * 6), change(research_facts=[fact] * 13),
        change(research_unknowns=["a"] * 7), change(research_facts=[{**fact, "topic": "x"}]),
        change(research_facts=[{**fact, "fact": ""}]), change(research_facts=[{**fact, "fact": "🙂" * 400}]),
        change(research_facts=[{**fact, "fact": "x" * 401}]), change(research_facts=[{**fact, "more": 1}]),
        change(research_facts=[fact, {"topic": "sns", "fact": "f"}]), change(research_facts=[fact, None]),
        change(research_facts=None), change(research_unknowns=["a", None]), change(research_unknowns=["a", 1]),
        change(company_name=""), change(company_name=5), change(company_name=None), without, change(extra=None),
        change(website="ftp://x"), change(website=""), change(website=True), change(source_url="https://"),
        change(source_url="https:///p"), change(source_url="HTTPS://X.example"), change(source_url=None),
        change(published_at="2026-02-30"), change(published_at="2026-9-1"), change(published_at=20260901),
        change(discovered_at="2026-09-01T10:00:00+09:00"), change(discovered_at="yesterday"),
        change(trigger_summary=""), change(trigger_title="a\nb \"quoted\" 🙂"), [], "text", 5, None, {},
    ]


def evaluation_cases():
    need = evaluation()["need"]
    rate = lambda value: evaluation(need={**need, "expression_gap": value})
    cover = evaluation()["evidence_coverage"]
    return [
        evaluation(), *[rate(value) for value in (0, 10, -1, 11, 5.5, 5.0, "5", True, None, [1], 2**70)],
        evaluation(need={key: 1 for key in list(need)[:4]}), evaluation(need={**need, "more": 1}), evaluation(need=None),
        evaluation(scope_hypothesis="x" * 300), evaluation(scope_hypothesis="x" * 301), evaluation(scope_hypothesis=""),
        evaluation(reason="x" * 601), evaluation(risks=["a"] * 4), evaluation(risks="a"), evaluation(risks=[None]),
        evaluation(research_needed=["a"] * 3), evaluation(strongest_signals=["a"] * 3),
        evaluation(evidence_coverage={**cover, "win": {"coverage": "none", "reason": "r"}}),
        evaluation(evidence_coverage={**cover, "win": {"coverage": "low", "reason": ""}}),
        evaluation(evidence_coverage={"need": cover["need"]}), evaluation(more=1),
    ]


def score_cases():
    base = {**dict.fromkeys(DIMENSION_WEIGHTS, 8), "reason": "ok", "risks": []}
    return [
        base, *[{**base, "timing": value} for value in (1.5, "7", " 7.5e0 ", "7d", "x", True, None, "nan", "inf", 1e300)],
        {**base, "more": 1}, {**base, "risks": [1]}, {key: base[key] for key in DIMENSION_WEIGHTS},
    ]


def test_both_validators_agree(spark, candidate):
    cases = [
        (records.CANDIDATE, candidate_cases(candidate)),
        (records.EVALUATION, evaluation_cases()),
        (records.LEGACY_SCORES, score_cases()),
        (records.STRATEGY, [strategy(), strategy(proposal={"title": "t"}), strategy(risks=[1]), strategy(more=1)]),
        (
            records.DISCOVERY,
            [{"candidates": value} for value in ([], [{}] * 10, [{}] * 11, [1], [{}, None], [{}, []], None, {})],
        ),
    ]
    raw = ['{"candidates":[]} x', '{"candidates":[]}] [', '{"candidates":[]},', "", "{", "nul", '{"a":1}}', '{"candidates": NaN}', '{"timing": Infinity}']
    for shape, values in cases:
        texts = [json.dumps(value, ensure_ascii=False) for value in values] + raw
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        found = {row.i: row.problem for row in with_problem(rows, "text", shape).collect()}
        for i, value in enumerate(texts):
            assert found[i] == text_problem(shape, value), value
        assert found[0] is None


def test_missing_text_is_malformed(spark):
    rows = spark.createDataFrame([(None,)], "text string")
    assert with_problem(rows, "text", records.EVALUATION).first().problem == "malformed"


def test_heavy_rows_are_dealt_to_more_tasks_as_a_table_grows(spark, tmp_path):
    """One split of a narrow file holds any number of rows."""
    for rows in (1_000, 40 * bindings.TASK_ROWS):
        spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/{rows}/narrow.parquet")
        dealt = bindings.spread_table(spark, f"{tmp_path}/{rows}", "narrow")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows and max(sizes) <= 1.1 * bindings.TASK_ROWS
