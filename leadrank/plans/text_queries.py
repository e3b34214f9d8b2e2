"""Queries over names, URLs, dates, fingerprints and request texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions import text
from leadrank.functions.records import CANDIDATE
from leadrank.operators import requests
from leadrank.operators.ids import assign_ids
from leadrank.plans.bindings import TODAY, table
from leadrank.plans.registry import query

FULL_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WIDE = "".join(chr(ord(letter) + 0xFEE0) for letter in FULL_WIDTH)


def decorated_name(name: Column, key: Column) -> Column:
    """A name as sources write it: with legal forms before or after, in wide letters, with gaps."""
    return (
        F.when(key % 7 == 0, name)
        .when(key % 7 == 1, F.concat(F.lit("株式会社 "), name))
        .when(key % 7 == 2, F.concat(name, F.lit("（株）")))
        .when(key % 7 == 3, F.translate(name, FULL_WIDTH, _WIDE))
        .when(key % 7 == 4, F.concat(F.lit("㈱"), name))
        .when(key % 7 == 5, F.concat(name, F.lit("　有限会社")))
        .otherwise(F.concat(F.lit("株式 会社"), name))
    )


def _names(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
        ("part", "p_partkey", "p_name"),
    ]
    tables = [
        table(spark, folder, name).select(F.lit(name).alias("kind"), F.col(key).alias("key"), F.col(label).alias("name"))
        for name, key, label in parts
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query(
    """WITH names AS (
  SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_name FROM part)
SELECT kind, key, CASE WHEN key % 7 = 6 THEN '株式会社' ELSE '' END || lower(replace(name, ' ', '')) AS normalized
FROM names"""
)
def normalized_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names in seven spellings, back to one form. A legal form with a gap inside stays."""
    names = _names(spark, folder)
    spelled = names.withColumn("name", decorated_name(F.col("name"), F.col("key")))
    return spelled.select("kind", "key", text.normalize_name(F.col("name")).alias("normalized"))


def page_variant(url: Column, key: Column) -> Column:
    """Page URLs in the forms that links come in."""
    return (
        F.when(key % 7 == 0, url)
        .when(key % 7 == 1, F.concat(F.upper(F.regexp_extract(url, "^[^/]*//[^/]*", 0)), F.regexp_extract(url, "^[^/]*//[^/]*(.*)$", 1)))
        .when(key % 7 == 2, F.regexp_replace(url, "://", "://www.www."))
        .when(key % 7 == 3, F.regexp_replace(url, "://([^/]*)", "://Me@$1:8080"))
        .when(key % 7 == 4, F.regexp_replace(url, "://([^/]*)", "://$1.."))
        .when(key % 7 == 5, F.concat(F.regexp_extract(url, "^[^/]*//[^/]*", 0), F.lit("?")))
    )


_SQL_VARIANTS = r"""
variants AS (
  SELECT page_id, CASE page_id % 7
    WHEN 0 THEN url
    WHEN 1 THEN upper(regexp_extract(url, '^[^/]*//[^/]*')) || regexp_extract(url, '^[^/]*//[^/]*(.*)$', 1)
    WHEN 2 THEN replace(url, '://', '://www.www.')
    WHEN 3 THEN regexp_replace(url, '://([^/]*)', '://Me@\1:8080')
    WHEN 4 THEN regexp_replace(url, '://([^/]*)', '://\1..')
    WHEN 5 THEN regexp_extract(url, '^[^/]*//[^/]*') || '?' END AS link
  FROM pages)"""


@query(
    rf"""WITH {_SQL_VARIANTS}
SELECT page_id, nullif(regexp_replace(rtrim(regexp_extract(lower(link), '^[a-z]+://(?:[^/?#]*@)?([^/:?#]*)', 1), '.'),
                       '^www\.', ''), '') AS domain
FROM variants"""
)
def website_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domain of every page link, in six spellings or missing."""
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id", text.website_domain(page_variant(F.col("url"), F.col("page_id"))).alias("domain")
    )


@query(
    rf"""WITH {_SQL_VARIANTS},
parts AS (
  SELECT page_id, link, lower(regexp_extract(link, '^([^:/?#]+)://([^/?#]*)', 1)) AS scheme,
         lower(regexp_extract(link, '^([^:/?#]+)://([^/?#]*)', 2)) AS host,
         regexp_extract(link, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(link, '^[^?#]*\?([^#]+)', 1) AS query
  FROM variants)
SELECT page_id, CASE WHEN link IS NOT NULL THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
       || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical
FROM parts"""
)
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical form of every page link."""
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id", text.canonical_url(page_variant(F.col("url"), F.col("page_id"))).alias("canonical")
    )


def page_title() -> Column:
    """Title of a page."""
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def page_language() -> Column:
    return F.regexp_extract("url", "^[^/]*//[^/]*/([a-z]+)/", 1)


def page_date() -> Column:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    return F.when(F.col("page_id") % 9 != 0, day)


SQL_PAGE = r"""
page AS (
  SELECT page_id, url, html, regexp_extract(url, '^[^/]*//[^/]*/([a-z]+)/', 1) AS lang,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         CASE WHEN page_id % 9 <> 0 THEN DATE '2024-01-01' + CAST(page_id % 400 AS INTEGER) END AS published
  FROM pages)"""


# SQL has no NFKC and no case folding. On the letters of the titles of these tables lower() differs from both in ß only;
# a test holds the query against both on all titles.
@query(
    rf"""WITH {SQL_PAGE}
SELECT page_id, sha256(lang || '|' || replace(lower(regexp_replace(title, '[\t-\r ]+', '', 'g')), 'ß', 'ss') || '|'
                       || coalesce(CAST(published AS VARCHAR), 'None')) AS fingerprint
FROM page"""
)
def trigger_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every page as a trigger."""
    return table(spark, folder, "pages").select(
        "page_id", text.trigger_fingerprint(page_language(), page_title(), page_date()).alias("fingerprint")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW'
         THEN CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) END AS published_epoch,
       CASE WHEN o_orderstatus = 'P' THEN 1726100000 ELSE 1700000000 + o_orderkey END AS discovered_epoch
FROM orders"""
)
def order_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """X5 + X6: midnight UTC of a date, and the own stamp or else the job clock."""
    day = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("date"))
    stamp = F.when(F.col("o_orderstatus") != "P", F.timestamp_seconds(F.col("o_orderkey") + 1700000000))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.unix_seconds(text.published_ts(day)).alias("published_epoch"),
        F.unix_seconds(text.discovered_ts(stamp, F.timestamp_seconds(F.lit(1726100000)))).alias(
            "discovered_epoch"
        ),
    )


_SECRETS = ("the", "hogehoge", "", "en")


@query(
    """SELECT doc_id, sha256(replace(replace(text, 'the', '[REDACTED]'), 'en', '[REDACTED]')) AS digest,
       length(replace(replace(text, 'the', '[REDACTED]'), 'en', '[REDACTED]')) AS characters
FROM documents"""
)
def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets replaced in whole texts."""
    safe = text.redact(F.col("text"), _SECRETS)
    return (
        table(spark, folder, "documents")
        .withColumn("safe", safe)
        .select("doc_id", F.sha2("safe", 256).alias("digest"), F.length("safe").cast("long").alias("characters"))
    )


@query(
    """SELECT o_orderkey, CAST(500 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS assigned_id FROM orders"""
)
def assigned_ids(spark: SparkSession, folder: str) -> DataFrame:
    """E5: ids that continue existing ones, in arrival order."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    return assign_ids(orders, "o_orderkey", "assigned_id", 500)


_SCHEMA = json.dumps(CANDIDATE.json_schema(), ensure_ascii=False, separators=(",", ":"))


@query(
    f"""SELECT 'topic-' || topic_no AS request_id,
       '{{"topic":"' || topic || '","today":"2024-06-30","preferred_since":"2024-05-31","candidate_schema":'
       || '{_SCHEMA}' || '}}' AS input, 'discovery-model' AS model, 'v6' AS prompt_version,
       'xhigh' AS reasoning_effort, true AS web_search
FROM (SELECT source AS topic, min(doc_id) AS topic_no FROM documents GROUP BY source)"""
)
def topic_requests(spark: SparkSession, folder: str) -> DataFrame:
    """P1 + P4: one discovery request per document source, with the configuration of its stage."""
    topics = (
        table(spark, folder, "documents")
        .groupBy(F.col("source").alias("topic"))
        .agg(F.min("doc_id").alias("topic_no"))
    )
    asked = requests.with_stage_config(
        requests.discovery_requests(topics, TODAY), requests.Settings(), "discovery"
    )
    return asked.select("request_id", "input", "model", "prompt_version", "reasoning_effort", "web_search")


@query(
    """SELECT 'trigger-' || c_custkey AS request_id,
       '{"company_name":"' || c_name || '","website":' ||
       CASE WHEN c_nationkey < 5 THEN 'null' ELSE '"https://c' || c_custkey || '.example"' END ||
       ',"trigger_type":"' || c_mktsegment || '"}' AS input,
       'scoring-model' AS model, 'v6' AS prompt_version, CAST(NULL AS VARCHAR) AS reasoning_effort,
       false AS web_search
FROM customer"""
)
def rating_requests(spark: SparkSession, folder: str) -> DataFrame:
    """P2 + P4: one scoring request per customer; null fields stay in the input."""
    found = _customer_candidates(spark, folder)
    asked = requests.scoring_requests(found, ["company_name", "website", "trigger_type"])
    return requests.with_stage_config(asked, requests.Settings(), "scoring").select(
        "request_id", "input", "model", "prompt_version", "reasoning_effort", "web_search"
    )


def _customer_candidates(spark: SparkSession, folder: str) -> DataFrame:
    site = F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("trigger_id"),
        F.col("c_name").alias("company_name"),
        F.when(F.col("c_nationkey") >= 5, site).alias("website"),
        F.col("c_mktsegment").alias("trigger_type"),
        ((F.col("c_custkey") * 37 % 4001) / F.lit(40.0)).alias("raw_score"),
    )


@query(
    """SELECT 'trigger-' || c_custkey AS request_id,
       '{"company_name":"' || c_name || '","trigger_type":"' || c_mktsegment || '"}' || chr(10) || 'Score: ' ||
       CASE WHEN total = floor(total) THEN printf('%.1f', total) ELSE printf('%g', total) END AS input,
       'strategy-model' AS model, 'v1' AS prompt_version, false AS web_search
FROM (SELECT *, CAST((c_custkey * 37 % 4001) // 40 AS DOUBLE) + (c_custkey * 37 % 4001) % 4 / 4 AS total FROM customer)"""
)
def proposal_requests(spark: SparkSession, folder: str) -> DataFrame:
    """P3 + P4: candidate and total of each selected score as one input."""
    total = F.floor(F.col("raw_score")) + (F.col("trigger_id") * 37 % 4001) % 4 / F.lit(4.0)
    selected = _customer_candidates(spark, folder).select(
        "trigger_id",
        F.struct("company_name", "trigger_type").alias("candidate_json"),
        total.cast("double").alias("total_score"),
    )
    asked = requests.with_stage_config(requests.strategy_requests(selected), requests.Settings(), "strategy")
    return asked.select("request_id", "input", "model", "prompt_version", "web_search")


_CONFIG = {
    "discovery_model": "discovery-model",
    "scoring_model": "scoring-model",
    "strategy_model": "strategy-model",
    "top_candidates": "5",
    "timezone": "Asia/Tokyo",
    "scoring_only": "true",
    "replay": "cache",
    "ranking": "equal_stage_geometric_mean_v1",
}


@query(
    f"""SELECT run_day, topic_count, {", ".join(f"'{value}' AS {name}" for name, value in _CONFIG.items())}
FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_day, count(DISTINCT event_type) AS topic_count
      FROM events GROUP BY 1)"""
)
def run_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The configuration stored with each run, read back by key."""
    days = table(spark, folder, "events").groupBy(F.col("ts").cast("date").cast("string").alias("run_day"))
    config = requests.run_config(requests.Settings(), scoring_only=True, replay="cache")
    runs = days.agg(F.countDistinct("event_type").alias("topic_count")).withColumn("config_json", config)
    return runs.select(
        "run_day", "topic_count", *[F.get_json_object("config_json", f"$.{name}").alias(name) for name in _CONFIG]
    )
