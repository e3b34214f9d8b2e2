import hashlib
import json
import random
import re
import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leadrank.functions import records
from leadrank.functions.fixed import LEGAL_FORMS, MESSAGE_UNITS
from leadrank.functions.text import trigger_fingerprint, utf16_chunks
from leadrank.operators import evidence as ev, ranking, report, runs
from leadrank.operators.inference import TransientError, batch_generate
from leadrank.operators.row_texts import split_rows
from leadrank.operators.validation import last_valid_attempt, review_candidates, validate_candidates
from leadrank.plans.text_queries import page_date, page_language, page_title
from leadrank.sources.files import read_responses, write_report
from tests.conftest import TEST_DATA
from tests.samples import completed


def scores(spark, rows):
    return spark.createDataFrame(rows, "run_id long, company_id long, trigger_id long, total_score double")


def test_top_is_one_row_per_company(spark):
    rows = scores(spark, [(1, 1, 1, 99.0), (1, 1, 2, 98.0), (1, 2, 3, 90.0), (1, 4, 5, 90.0), (1, 3, 4, 90.0)])
    top = ranking.select_top(rows, 3).orderBy("selected_rank").collect()
    assert [(row.company_id, row.trigger_id, row.selected_rank) for row in top] == [(1, 1, 1), (2, 3, 2), (3, 4, 3)]
    with pytest.raises(ValueError):
        ranking.select_top(rows, 0)


def test_ranking_prunes_before_the_shuffle(spark):
    rows = scores(spark, [(1, 1, 1, 99.0)])
    plan = ranking.select_top(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_precision_needs_complete_runs(spark):
    ranked = [(run, company, rank) for run, n in ((1, 5), (2, 4), (3, 5)) for rank, company in enumerate(range(n), 1)]
    ratings = [
        (i, run, company, "good" if company < 3 else "bad")
        for i, (run, company, _) in enumerate(ranked)
        if not (run == 1 and company == 4)
    ]
    result = ranking.precision_at_k(
        spark.createDataFrame(ranked, "run_id long, company_id long, selected_rank int"),
        spark.createDataFrame(ratings, "id long, run_id long, company_id long, rating string"),
    ).collect()
    assert [(row.run_id, row.precision_at_5) for row in result] == [(3, 0.6)]


def test_evidence_ignores_generated_text(spark):
    response = {
        "status": "completed",
        "output": [
            {"type": "web_search_call", "status": "completed",
             "action": {"type": "search", "sources": [{"url": "https://real.example/news"}]}},
            {"type": "message", "content": [{"type": "output_text", "text": "https://invented.example",
             "annotations": [{"type": "url_citation", "url": "https://cited.example"}]}]},
        ],
    }
    rows = spark.createDataFrame([("r", json.dumps(response))], "request_id string, response string")
    found = {row.url for row in ev.extract_evidence(rows).collect()}
    assert found == {"https://real.example/news", "https://cited.example"}


def test_review_gates(spark, candidate):
    from datetime import date

    facts = [{"topic": "sns", "fact": "f", "source_url": "https://invented.example/"}]
    items = [
        candidate,
        {**candidate, "source_url": "https://invented.example"},
        {"company_name": "invalid"},
        {**candidate, "research_facts": facts},
        {**candidate, "published_at": "2026-09-13"},
        {**candidate, "published_at": "2026-09-12"},
        {**candidate, "published_at": None},
        {**candidate, "source_url": "HTTPS://Example.com:443/news/1#top"},
    ]
    rows = spark.createDataFrame(
        [(i, json.dumps(item), ["https://example.com/news/1"]) for i, item in enumerate(items)],
        "i int, item string, evidence array<string>",
    )
    reasons = {row.i: row.reject_reason for row in review_candidates(rows, date(2026, 9, 12)).collect()}
    assert [reasons[i] for i in range(len(items))] == [
        None, "unverified_source", "website", "unverified_research", "future_date", None, None, None,
    ]


def run_model(spark, call, pauses=None):
    ddl = "request_id string, input string, model string, reasoning_effort string, web_search boolean"
    rows = spark.createDataFrame([("r", "x", "m", None, True)], ddl)
    return batch_generate(rows, call, records.DISCOVERY, pause=lambda seconds: None).first()


def answers(*replies):
    """A call that replies in turn; the last reply repeats. Counting works inside one task."""
    calls = []

    def call(request):
        calls.append(request)
        reply = replies[min(len(calls), len(replies)) - 1]
        if isinstance(reply, Exception):
            raise reply
        return reply

    return call


def test_retries_are_bounded(spark):
    good, bad = completed('{"candidates": []}', ["https://b.example"]), completed("broken", ["https://a.example"])
    row = run_model(spark, answers(bad, good))
    assert (row.attempt_count, row.call_count, row.error_type) == (2, 2, None)
    assert row.evidence == ["https://a.example", "https://b.example"]
    row = run_model(spark, answers(completed("{}")))
    assert (row.call_count, row.text, row.error_type) == (3, None, "InvalidOutputError")
    row = run_model(spark, answers(PermissionError("secret")))
    assert (row.call_count, row.error_type) == (1, "PermissionError")
    row = run_model(spark, answers(TransientError("secret")))
    assert (row.call_count, row.error_type) == (4, "TransientError")
    row = run_model(spark, answers(TransientError(), good))
    assert (row.call_count, row.attempt_count, row.error_type) == (2, 1, None)
    row = run_model(spark, answers({**good, "status": "incomplete"}))
    assert (row.call_count, row.error_type) == (3, "InvalidOutputError")


def test_error_report(spark):
    errors = spark.createDataFrame(
        [(42, 2, "scoring", "RuntimeError", False), (42, 1, "pipeline", "ValueError", True)],
        "run_id long, ord long, stage string, error_type string, fatal boolean",
    )
    messages = runs.error_messages(errors, width=1)
    assert messages.first().error_message == "pipeline: ValueError; scoring: RuntimeError"
    states = runs.run_status(spark.createDataFrame([(42,), (43,)], "run_id long"), errors)
    assert {row.run_id: row.status for row in states.collect()} == {42: "failed", 43: "completed"}
    text = report.format_error_report(states, messages).first().report
    assert "Run: 42\nStatus: failed" in text and text.endswith("・pipeline: ValueError\n・scoring: RuntimeError")


def test_report_without_entries(spark):
    run = spark.createDataFrame(
        [(1, "2026-09-12", "completed", 0, 0, 0)],
        "run_id long, day string, status string, candidate_count int, scored_count int, strategy_count int",
    )
    ddl = (
        f"run_id long, selected_rank int, total_score double, candidate_json {records.CANDIDATE_DDL}, "
        f"evaluation_json {records.EVALUATION_DDL}, strategy_json {records.STRATEGY_DDL}"
    )
    text = report.format_report(run, spark.createDataFrame([], ddl)).first().report
    assert text.split("\n") == [
        "# Sales Report", "2026-09-12", "Run: 1 / completed", "探索企業: 0", "評価企業: 0", "Top candidates: 0",
        "戦略生成: 0",
    ]


def test_split_messages(spark):
    texts = spark.createDataFrame([(1, "日本語🙂" * 1600), (2, "")], "run_id long, report string")
    pieces = report.split_messages(texts, "report", ["run_id"]).orderBy("chunk_no").collect()
    assert "".join(row.chunk for row in pieces) == "日本語🙂" * 1600
    assert {row.run_id for row in pieces} == {1}
    assert texts.where(F.length("report") == 0).count() == 1


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("limit", [2, 3, 7, 50])
def test_rows_are_cut_as_their_joined_text(spark, width, limit):
    rng = random.Random(limit)
    letters = ["a", "語", "🙂", "🙂🙂", "e\u0301", "", None]
    rows = [(run, n // 2, "".join(filter(None, rng.choices(letters, k=rng.randrange(9)))) or None)
            for run, size in ((5, 40), (2, 1), (9, 0), (7, 23)) for n in range(size)]
    texts = {}
    for run, _, text in sorted(rows, key=lambda row: (row[0], row[1], (row[2] or "").encode())):
        texts[run] = texts.get(run, "") + (text or "")
    parts = spark.createDataFrame(rows, "run_id long, ord long, text string").repartition(5)
    found = split_rows(parts, ["ord"], limit, width=width).orderBy("run_id", "chunk_no").collect()
    expected = [(run, n, chunk) for run in sorted(texts) for n, chunk in enumerate(utf16_chunks(texts[run], limit))]
    assert [tuple(row) for row in found] == expected


def test_alerts_of_very_many_errors_have_no_large_value(spark):
    errors = spark.range(100_000).selectExpr(
        "42L AS run_id", "id * 3 AS ord", "'scoring' AS stage", "concat('Fault', id % 1000) AS error_type"
    )
    states = spark.createDataFrame([(42, "partial"), (43, "completed")], "run_id long, status string")
    pieces = report.error_report_pieces(states, errors, width=1 << 10).orderBy("chunk_no").collect()
    text = report.format_error_report(states, runs.error_messages(errors)).first().report
    assert [row.chunk for row in pieces] == utf16_chunks(text, MESSAGE_UNITS)
    assert [row.chunk_no for row in pieces] == list(range(len(pieces))) and {row.run_id for row in pieces} == {42}


def test_long_reports_are_ordered_files(spark, tmp_path):
    chunks = spark.range(3000).selectExpr("id % 2 as run_id", "id as chunk_no", "concat('line ', id) as chunk").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_report(chunks, str(tmp_path / "reports"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for run in (0, 1):
        files = sorted((tmp_path / "reports" / f"run_id={run}").glob("part-*"))
        lines = [line for file in files for line in file.read_text().splitlines()]
        assert len(files) > 1 and lines == [f"line {n}" for n in range(run, 3000, 2)]


def test_calls_are_spread_and_faults_stay_in_their_rows(spark):
    def call(request):
        kind = int(request["input"]) % 4
        text = ['{"candidates":[]}', "[" * 100_000, '{"candidates":[],"candidates":[]}'][kind] if kind < 3 else ""
        return None if kind == 3 else {"status": "completed", "output_text": text, "output": [7, {"type": "message", "content": 5}]}

    asked = spark.range(40).selectExpr(
        "cast(id as string) as request_id", "cast(id as string) as input", "'m' as model",
        "cast(null as string) as reasoning_effort", "true as web_search",
    )
    answers = batch_generate(asked.coalesce(1), call, records.DISCOVERY, pause=lambda seconds: None)
    rows = answers.withColumn("task", F.spark_partition_id()).collect()
    assert len({row.task for row in rows}) > 1
    expected = [None, "InvalidOutputError", "InvalidOutputError", "AttributeError"]
    assert all(row.error_type == expected[int(row.request_id) % 4] for row in rows) and len(rows) == 40


def test_dates_end_where_they_end(spark, candidate):
    items = [{**candidate, "published_at": day} for day in ("2024-01-01", "2024-01-01\n", "2024-01-01 ", "2024-13-01")]
    frame = spark.createDataFrame([(n, json.dumps(item)) for n, item in enumerate(items)], "n long, item string")
    found = {row.n: row.reject_reason for row in validate_candidates(frame).collect()}
    assert [found[n] is None for n in range(4)] == [True, False, False, False]
    plain = [records.CANDIDATE.problem(item) for item in items]
    assert [problem is None for problem in plain] == [True, False, False, False]


def test_attempts_count_by_their_order(spark):
    """Numbers from 1, from 3, with gaps and repeats; the first three count, and no request vanishes."""
    bad, good = "empty", None
    cases = {
        "from one": ([(1, bad), (2, bad), (3, good)], 3, "3"),
        "late only": ([(3, good)], 1, "3"),
        "late and bad": ([(7, bad)], 1, None),
        "gaps": ([(2, bad), (40, good), (41, bad)], 2, "40"),
        "fourth is good": ([(0, bad), (1, bad), (2, bad), (3, good)], 3, None),
        "repeated": ([(0, bad), (1, bad), (1, good), (2, bad)], 2, "1"),
        "without number": ([(None, bad), (5, good)], 2, "5"),
    }
    rows = [(name, n, f"{n}", [f"e{n}"], problem) for name, (tries, _, _) in cases.items() for n, problem in tries]
    attempts = spark.createDataFrame(rows, "request_id string, attempt int, text string, evidence array<string>, problem string")
    found = {row.request_id: row for row in last_valid_attempt(attempts.repartition(3)).collect()}
    assert set(found) == set(cases)
    for name, (_, count, text) in cases.items():
        assert (found[name].attempt_count, found[name].text) == (count, text)
        assert found[name].error_type == (None if text else "InvalidOutputError")
    assert found["fourth is good"].evidence == ["e0", "e1", "e2"] and found["gaps"].evidence == ["e2", "e40"]


def test_equal_broken_lines_are_requests_of_their_own(spark, tmp_path):
    (tmp_path / "a.json").write_text('not json\n' * 50 + '{"topic_no": 1}\n' * 3 + '{"request_id": "r", "response": "x"}\n\n')
    found = read_responses(spark, str(tmp_path))
    names = [row.request_id for row in found.collect()]
    assert len(names) == 54 and len(set(names)) == 54 and "r" in names
    assert sorted(names) == sorted(row.request_id for row in found.collect())


def test_fingerprints_of_whole_titles(spark):
    """All titles of the pages, and some that need NFKC and case folding."""
    pages = [(row.page_id, row.url, row.html) for row in spark.read.parquet(f"{TEST_DATA}/sf0.1/pages.parquet").collect()]
    odd = ["Ｆｕｌｌ　Ｗｉｄｔｈ ①", "ﬁne STRASSE straße ẞ", "İstanbul ΣΊΣΥΦΟΣ", "新ブランド㍿ 開始", "e\u0301 e\u0301\u0323", "\u00a0 \u2003x"]
    for n, title in enumerate(odd):
        pages.append((10**6 + n, "https://a.example/news/x", f"<title>{title}</title>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    shown = frame.select("page_id", trigger_fingerprint(page_language(), page_title(), page_date()).alias("fingerprint"))
    found = {row.page_id: row.fingerprint for row in shown.collect()}
    for page, url, html in pages:
        title = re.search("<title>([^<]*)</title>", html)
        name = unicodedata.normalize("NFKC", title[1] if title else "").casefold()
        for form in LEGAL_FORMS:
            name = name.replace(form, "")
        day = str(date(2024, 1, 1) + timedelta(page % 400)) if page % 9 else "None"
        kind = re.match("[^/]*//[^/]*/([a-z]+)/", url)
        key = "|".join((kind[1] if kind else "", re.sub(r"\s+", "", name), day))
        assert found[page] == hashlib.sha256(key.encode()).hexdigest()
