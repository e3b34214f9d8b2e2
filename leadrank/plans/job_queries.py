"""Queries over batch inference, files, stored tables and whole runs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions import records
from leadrank.operators.ids import assign_ids
from leadrank.operators.inference import TransientError, batch_generate, failed_rows
from leadrank.operators.report import split_messages
from leadrank.operators.requests import Settings
from leadrank.operators.validation import review_candidates, split_accept_reject
from leadrank.plans.bindings import TODAY, table
from leadrank.plans.daily import run_batch
from leadrank.plans.evidence_queries import _document_items, _page_responses
from leadrank.plans.registry import query
from leadrank.session import cut_lineage, scratch_path
from leadrank.sources.files import (
    read_ratings,
    read_replay,
    read_responses,
    write_discovery_cache,
    write_report,
)
from leadrank.sources.tables import Store
from leadrank.streaming.arrivals import run_available

_AS_OF = datetime(2024, 6, 30, 12, tzinfo=timezone.utc)


def scripted_model():
    """A deterministic model: the customer number in the input decides how it answers."""
    transport: dict[str, int] = {}

    def call(request: dict) -> dict:
        number = int(request["input"])
        page = f"https://e.example/{number}/{request['instructions'].count('The last answer')}"
        opened = {"type": "web_search_call", "status": "completed", "action": {"type": "open_page", "url": page}}
        kind = number % 8
        if kind == 3:
            transport[request["input"]] = transport.get(request["input"], 0) + 1
            if transport[request["input"]] <= 2:
                raise TransientError
        if kind == 4:
            raise PermissionError("a key that must not be stored")
        if kind == 5:
            raise TransientError
        if kind == 6:
            return None
        retried = "The last answer" in request["instructions"]
        valid = kind in (0, 3) or (kind == 1 and retried)
        return {
            "status": "completed",
            "output_text": '{"candidates":[]}' if valid else "[" * 200_000 if kind == 7 else "sorry",
            "output": [opened],
        }

    return call


def _customer_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("request_id"),
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("subject"),
        F.col("c_custkey").cast("string").alias("input"),
        F.lit("m").alias("model"),
        F.lit(None).cast("string").alias("reasoning_effort"),
        F.lit(True).alias("web_search"),
    )


def _answers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = _customer_requests(spark, folder)
    return asked, batch_generate(asked, scripted_model(), records.DISCOVERY, pause=lambda seconds: None)


@query(
    """WITH asked AS (SELECT c_custkey AS n, c_custkey % 8 AS kind FROM customer)
SELECT 'customer-' || n AS request_id,
       CAST(CASE WHEN kind = 1 THEN 2 WHEN kind IN (2, 7) THEN 3 ELSE 1 END AS INTEGER) AS attempt_count,
       CAST(CASE WHEN kind = 1 THEN 2 WHEN kind IN (2, 3, 7) THEN 3 WHEN kind = 5 THEN 4 ELSE 1 END AS INTEGER) AS call_count,
       CASE WHEN kind IN (0, 1, 3) THEN '{"candidates":[]}' END AS text,
       CASE WHEN kind IN (4, 5, 6) THEN '' ELSE 'https://e.example/' || n || '/0' ||
         CASE WHEN kind IN (1, 2, 7) THEN ' https://e.example/' || n || '/1' ELSE '' END ||
         CASE WHEN kind IN (2, 7) THEN ' https://e.example/' || n || '/2' ELSE '' END END AS evidence,
       CASE WHEN kind IN (2, 7) THEN 'InvalidOutputError' WHEN kind = 4 THEN 'PermissionError'
         WHEN kind = 5 THEN 'TransientError' WHEN kind = 6 THEN 'AttributeError' END
         AS error_type
FROM asked"""
)
def generated_answers(spark: SparkSession, folder: str) -> DataFrame:
    """B1: one answer per customer, with bounded retries on invalid output and on transport faults."""
    _, answers = _answers(spark, folder)
    return answers.withColumn("evidence", F.array_join("evidence", " "))


@query(
    """SELECT c_custkey AS ord, 'discovery' AS stage, c_name AS subject,
  CASE c_custkey % 8 WHEN 4 THEN 'PermissionError' WHEN 5 THEN 'TransientError' WHEN 6 THEN 'AttributeError'
    ELSE 'InvalidOutputError' END AS error_type FROM customer WHERE c_custkey % 8 IN (2, 4, 5, 6, 7)"""
)
def isolated_errors(spark: SparkSession, folder: str) -> DataFrame:
    """B2: failed requests as error rows with the class of the error only."""
    asked, answers = _answers(spark, folder)
    return failed_rows(answers, asked, "discovery", "subject")


@query(
    """SELECT page_id AS topic_no, regexp_extract(url, '^[^/]*//[^/]*/([a-z]+)/', 1) AS request_id,
       page_id % 8 <> 3 AS completed FROM pages"""
)
def stored_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Raw responses written as JSON lines and read back, all of them."""
    path = scratch_path(spark)
    _page_responses(spark, folder).select(
        F.col("page_id").alias("topic_no"),
        F.col("request_id").alias("topic"),
        "request_id",
        F.lit(0).alias("attempt"),
        "response",
    ).write.json(path)
    return read_responses(spark, path).select(
        "topic_no", "request_id", (F.get_json_object("response", "$.status") == "completed").alias("completed")
    )


@query(
    "SELECT count(*) AS lines, count(*) AS requests, CAST(0 AS BIGINT) AS usable FROM lineitem"
)
def unreadable_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are no response, most of them equal; each one is a failed request of its own."""
    path = scratch_path(spark)
    line = F.concat(F.lit('{"broken": '), "l_returnflag")
    table(spark, folder, "lineitem").select(line.alias("value")).write.text(path)
    return read_responses(spark, path).agg(
        F.count("*").alias("lines"), F.count_distinct("request_id").alias("requests"), F.count("response").alias("usable")
    )


@query(
    """WITH changes AS (
  SELECT o_custkey AS id, CAST(o_orderkey % 5 AS BIGINT) + 1 AS run, max(o_orderkey) AS last FROM orders GROUP BY ALL),
latest AS (SELECT id, max(run) AS run, arg_max(last, run) AS last FROM changes GROUP BY id)
SELECT id, 'order ' || last AS name, 'run ' || run AS location FROM latest"""
)
def compacted_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as companies that five runs change; their state is written whole, in buckets, after the third."""
    store = Store(spark, scratch_path(spark))
    store.ensure_tables()
    run = F.pmod("o_orderkey", F.lit(5)) + 1
    changes = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id"), run.alias("run")).agg(
        F.concat(F.lit("order "), F.max("o_orderkey").cast("string")).alias("name")
    )
    changes = cut_lineage(changes)
    empty, seen = F.lit(None).cast("string"), F.lit(datetime(2024, 7, 1, tzinfo=timezone.utc))
    for number in range(1, 6):
        store.compact_companies(number, after=2, bucket_rows=1_000)
        rows = changes.where(F.col("run") == number).select(
            "id",
            "name",
            F.lower("name").alias("normalized_name"),
            empty.alias("website"),
            empty.alias("website_domain"),
            F.lit(f"run {number}").alias("location"),
            seen.alias("first_seen_at"),
            seen.alias("last_seen_at"),
        )
        store.write_run(rows, "companies", number)
    return store.read("companies").select("id", "name", "location")


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    accepted, _ = split_accept_reject(review_candidates(_document_items(spark, folder), TODAY))
    return accepted.select(F.col("doc_id").alias("ord"), "candidate.*")


@query(
    f"""SELECT doc_id AS ord, source AS company_name, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR)
         AS published_at, CASE WHEN doc_id % 14 = 13 THEN 0 ELSE 1 END AS facts, length(text) AS summary_length
FROM documents
WHERE doc_id % 14 IN (0, 5, 6, 13) AND (doc_id % 14 = 13 OR length(text) BETWEEN 1 AND 400) AND doc_id % 5 <> 0
  AND DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) <= DATE '{TODAY}'"""
)
def replayed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """S2 + S3: accepted candidates saved as a cache and read back with a new check of every item."""
    path = scratch_path(spark)
    write_discovery_cache(_accepted(spark, folder), path)
    return read_replay(spark, path).select(
        "ord",
        "company_name",
        F.col("published_at").cast("string").alias("published_at"),
        F.size("research_facts").alias("facts"),
        F.length("trigger_summary").cast("long").alias("summary_length"),
    )


@query(
    """SELECT event_id AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS run_id,
       'stage' AS stage, event_type AS error_type FROM events"""
)
def stored_errors(spark: SparkSession, folder: str) -> DataFrame:
    """S4 + S6: tables created empty, error rows appended by run, and read back."""
    store = Store(spark, scratch_path(spark))
    store.ensure_tables()
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"),
        F.lit("stage").alias("stage"),
        F.lit("s").alias("subject"),
        F.col("event_type").alias("error_type"),
        F.lit("m").alias("model"),
        F.lit("v").alias("prompt_version"),
        F.lit(_AS_OF).alias("created_at"),
    )
    store.append_table(rows, "processing_errors")
    return store.read("processing_errors").select("id", "run_id", "stage", "error_type")


@query(
    """SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE 'maybe' END AS rating
FROM labels"""
)
def imported_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Human ratings read from CSV files with the declared schema."""
    path = scratch_path(spark)
    rating = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("maybe")
    table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("company_id"),
        F.lit(1).alias("run_id"),
        rating.alias("rating"),
        F.lit(None).cast("string").alias("comment"),
        F.lit(None).cast("string").alias("created_at"),
    ).write.option("header", True).csv(path)
    return read_ratings(spark, path, "csv").select("id", "rating")


@query(
    """SELECT item_id AS run_id, replace(replace(text, chr(10), ' '), 'the', '[REDACTED]') AS report FROM benchmark"""
)
def written_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports in pieces, written as text by run with secrets removed, and read back whole."""
    path = scratch_path(spark)
    # Text files end a row at a line break.
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    texts = table(spark, folder, "benchmark").select(F.col("item_id").alias("run_id"), line.alias("line"))
    write_report(split_messages(texts, "line", ["run_id"]), path, ["the"])
    return spark.read.text(path).select(F.col("run_id").cast("long").alias("run_id"), F.col("value").alias("report"))


def _page_model():
    """Rates and proposes for candidates made from pages; fails on casinos."""
    stages = {
        stage: {name: 4 + index for index, name in enumerate(names)}
        for stage, names in records.STAGES.items()
    }
    evaluation = json.dumps(
        {
            **stages,
            "scope_hypothesis": "scope",
            "evidence_coverage": {stage: {"coverage": "low", "reason": "r"} for stage in stages},
            "reason": "r",
            "strongest_signals": [],
            "risks": [],
            "research_needed": [],
        }
    )
    strategy = json.dumps(
        {
            name: {"title": "t", "description": "d", "deliverables": []} if name == "proposal"
            else [] if name in ("risks", "research_notes") else "x"
            for name in records.STRATEGY.fields
        }
    )

    def call(request: dict) -> dict:
        if "casino" in request["input"]:
            raise RuntimeError
        text = strategy if "\nScore: " in request["input"] else evaluation
        return {"status": "completed", "output_text": text, "output": []}

    return call


def page_response_lines(
    spark: SparkSession, folder: str, title: Column | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """One recorded response per page that found one company: the page's host. It opened the page and `also` others."""
    title = F.concat(F.lit("story "), F.length("url").cast("string")) if title is None else title
    host = F.regexp_extract("url", "^[^/]*//([^/]*)", 1)
    candidate = F.to_json(
        F.struct(
            host.alias("company_name"),
            F.col("url").alias("website"),
            F.lit("news").alias("trigger_type"),
            title.alias("trigger_title"),
            F.lit("").alias("trigger_summary"),
            F.lit("2024-06-01").alias("published_at"),
            F.col("url").alias("source_url"),
            F.lit("").alias("source_title"),
            F.lit("").alias("location"),
            F.lit("").alias("possible_video_need"),
        )
    )
    opened = [
        F.struct(
            F.lit("web_search_call").alias("type"),
            F.lit("completed").alias("status"),
            F.struct(F.lit("open_page").alias("type"), url.alias("url")).alias("action"),
        )
        for url in (*map(F.lit, also), F.col("url"))
    ]
    response = F.to_json(
        F.struct(
            F.lit("completed").alias("status"),
            F.concat(F.lit('{"candidates":['), candidate, F.lit("]}")).alias("output_text"),
            F.array(*opened).alias("output"),
        )
    )
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("topic_no"),
        F.lit("pages").alias("topic"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("request_id"),
        F.lit(0).alias("attempt"),
        response.alias("response"),
    )


_SQL_RUN = r"""
host AS (SELECT regexp_extract(url, '^[^/]*//([^/]*)', 1) AS full_host, *,
                regexp_replace(regexp_extract(url, '^[^/]*//([^/]*)', 1), '^www\.', '') AS d FROM pages)"""


@query(
    f"""WITH {_SQL_RUN}
SELECT 1 AS run_id, CASE WHEN bool_or(contains(url, 'casino')) THEN 'partial' ELSE 'completed' END AS status,
       count(DISTINCT d) AS candidate_count, count(DISTINCT d) FILTER (WHERE NOT contains(url, 'casino')) AS scored_count,
       least(5, count(DISTINCT d) FILTER (WHERE NOT contains(url, 'casino'))) AS strategy_count FROM host
UNION ALL
SELECT 2, 'completed', count(DISTINCT d), count(DISTINCT d) FILTER (WHERE contains(url, 'casino')),
       least(5, count(DISTINCT d) FILTER (WHERE contains(url, 'casino'))) FROM host"""
)
def two_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run over all pages in which casinos fail, and a second one that scores only those.

    Every host is a company of its own, so the counts follow from the pages.
    """
    store = Store(spark, scratch_path(spark))
    responses = cut_lineage(page_response_lines(spark, folder))
    forgiving = _page_model()

    def second(request: dict) -> dict:
        return forgiving({**request, "input": request["input"].replace("casino", "")})

    run_batch(spark, store.root, Settings(), forgiving, _AS_OF, responses=responses)
    run_batch(spark, store.root, Settings(), second, _AS_OF, responses=responses)
    return _run_rows(store)


@query(
    f"""WITH {_SQL_RUN}
SELECT 1 AS run_id, 'completed' AS status, count(DISTINCT d) AS candidate_count, count(DISTINCT d) AS scored_count,
       CAST(0 AS BIGINT) AS strategy_count FROM host"""
)
def arriving_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The run over response files that have arrived, as a stream that stops when none are left."""
    arrivals = scratch_path(spark)
    page_response_lines(spark, folder).write.json(arrivals)
    store = Store(spark, scratch_path(spark))
    store.ensure_tables()
    model = _page_model()

    def call(request: dict) -> dict:
        return model({**request, "input": request["input"].replace("casino", "")})

    run_available(spark, arrivals, store.root, Settings(), call, lambda: _AS_OF, scoring_report=True)
    return _run_rows(store)


def _run_rows(store: Store) -> DataFrame:
    return store.read("runs").select(
        F.col("id").cast("int").alias("run_id"),
        "status",
        F.col("candidate_count").cast("long").alias("candidate_count"),
        F.col("scored_count").cast("long").alias("scored_count"),
        F.col("strategy_count").cast("long").alias("strategy_count"),
    )


_OPENED = ("https://zz.example/", "https://aa.example/")


def _crowded_store(spark: SparkSession, folder: str) -> Store:
    """A store after one run over files in which seven topics share all responses and every tenth line is broken."""
    path = scratch_path(spark)
    lines = page_response_lines(spark, folder, F.col("url"), _OPENED)
    broken = F.concat(F.lit('{"topic": '), F.col("request_id"))
    number = F.col("topic_no")
    record = F.to_json(F.struct((number % 7).alias("topic_no"), "topic", "request_id", "attempt", "response"))
    lines.select(F.when(number % 10 == 9, broken).otherwise(record).alias("value")).write.text(path)
    store = Store(spark, scratch_path(spark))
    model = _page_model()

    def call(request: dict) -> dict:
        return model({**request, "input": request["input"].replace("casino", "")})

    responses = cut_lineage(read_responses(spark, path))
    run_batch(spark, store.root, Settings(), call, _AS_OF, responses=responses, scoring_report=True)
    return store


@query(
    f"""WITH {_SQL_RUN}
SELECT 'company' AS kind, d AS name, count(DISTINCT regexp_replace(url, '#.*$', '')) AS n
FROM host WHERE page_id % 10 <> 9 GROUP BY d
UNION ALL SELECT 'discovery', 'InvalidOutputError', count(*) FROM host WHERE page_id % 10 = 9 HAVING count(*) > 0
UNION ALL SELECT 'run', 'partial', 1"""
)
def crowded_topics(spark: SparkSession, folder: str) -> DataFrame:
    """S1 + I1: companies with their triggers, and the errors, of a run with many responses per topic and broken lines."""
    store = _crowded_store(spark, folder)
    triggers = store.read("triggers").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    companies = store.read("companies").join(triggers, "id", "left")
    errors = store.read("processing_errors").groupBy("stage", "error_type").agg(F.count("*").alias("n"))
    return (
        companies.select(F.lit("company").alias("kind"), F.col("website_domain").alias("name"), "n")
        .union(errors.select("stage", "error_type", "n"))
        .union(store.read("runs").select(F.lit("run"), "status", F.lit(1).cast("long")))
    )


@query(
    f"""WITH {_SQL_RUN}, articles AS (
  SELECT DISTINCT regexp_replace(url, '#.*$', '') AS article FROM host WHERE page_id % 10 <> 9)
SELECT article, array_to_string(list_sort([article, 'https://aa.example/', 'https://zz.example/']), ' ') AS evidence
FROM articles"""
)
def stored_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Stored triggers with the sorted URLs of the pages that their response opened."""
    triggers = _crowded_store(spark, folder).read("triggers")
    return triggers.select(F.col("source_url").alias("article"), F.array_join("evidence_urls", " ").alias("evidence"))


@query(
    """SELECT CAST(row_number() OVER (ORDER BY lang, doc_id) AS BIGINT) AS ord, lang AS topic, doc_id FROM documents"""
)
def united_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of all topics as one list, topic after topic."""
    found = table(spark, folder, "documents").select(F.col("lang").alias("topic"), "doc_id")
    return assign_ids(found, ["topic", "doc_id"], "ord")
