"""Queries over responses: evidence, gates, validation, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions import records
from leadrank.functions.fixed import DIMENSION_WEIGHTS, STAGES
from leadrank.functions.scoring import weighted_total
from leadrank.operators import evidence as ev, validation as va
from leadrank.plans.bindings import TODAY, spread_table, table
from leadrank.plans.registry import query
from leadrank.plans.text_queries import SQL_PAGE, page_date, page_language


def _page_responses(spark: SparkSession, folder: str) -> DataFrame:
    """A raw response per page; the kind of output item depends on the page."""
    url = F.col("url")
    kind = F.col("page_id") % 8
    action = lambda value: F.concat(F.lit('{"type":"'), value, F.lit('"'))
    quoted = F.concat(F.lit('"'), url, F.lit('"'))
    sources = F.concat(
        F.lit('"sources":[{"url":'), quoted, F.lit('},{"url":"'), url, F.lit('&again=1"},{"url":""},{"url":null}]')
    )
    search = lambda status: F.concat(
        F.lit(f'{{"type":"web_search_call","status":"{status}","action":'),
        action(F.lit("search")), F.lit(","), sources, F.lit("}}"),
    )
    opened = F.concat(
        F.lit('{"type":"web_search_call","status":"completed","action":'),
        action(F.lit("open_page")), F.lit(',"url":'), quoted, F.lit("}}"),
    )
    found = F.concat(
        F.lit('{"type":"web_search_call","status":"completed","action":'),
        action(F.lit("find_in_page")), F.lit(',"url":'), quoted, F.lit("}}"),
    )
    message = lambda note: F.concat(
        F.lit('{"type":"message","content":[{"type":"output_text","text":"see '), url,
        F.lit(f'","annotations":[{{"type":"{note}","url":'), quoted, F.lit("}]}]}"),
    )
    item = (
        F.when(kind == 0, search("completed"))
        .when(kind == 1, search("failed"))
        .when(kind == 2, opened)
        .when(kind == 3, found)
        .when(kind == 4, message("url_citation"))
        .when(kind == 5, message("file_citation"))
        .when(kind == 6, F.concat(search("completed"), F.lit(","), message("url_citation")))
        .otherwise(F.lit('{"type":"reasoning"}'))
    )
    status = F.when(kind == 3, "incomplete").otherwise("completed")
    response = F.concat(F.lit('{"status":"'), status, F.lit('","output":['), item, F.lit("]}"))
    return table(spark, folder, "pages").select(
        "page_id", page_language().alias("request_id"), response.alias("response")
    )


_SQL_EVIDENCE = f"""{SQL_PAGE},
evidence AS (
  SELECT page_id, lang AS request_id, url FROM page WHERE page_id % 8 IN (0, 2, 4, 6)
  UNION ALL SELECT page_id, lang, url || '&again=1' FROM page WHERE page_id % 8 IN (0, 6))"""


@query(f"WITH {_SQL_EVIDENCE} SELECT page_id, request_id, url FROM evidence")
def response_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of every response; URLs in generated text do not count."""
    return ev.extract_evidence(_page_responses(spark, folder))


@query(f"WITH {_SQL_EVIDENCE} SELECT DISTINCT request_id, url FROM evidence")
def request_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A9 + U2: distinct evidence of each request over all its responses."""
    return ev.collect_evidence(_page_responses(spark, folder))


@query("SELECT page_id FROM pages WHERE page_id % 8 <> 3")
def completed_responses(spark: SparkSession, folder: str) -> DataFrame:
    """V6: responses with status `completed`."""
    responses = _page_responses(spark, folder).withColumn("parsed", ev.parse_response(F.col("response")))
    return responses.where(ev.response_completed(F.col("parsed"))).select("page_id")


def _page_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as candidates; some claim the topic of another language, some cite an unseen page."""
    url = F.col("url")
    topic = F.when(F.col("page_id") % 7 == 0, F.lit("en")).otherwise(page_language())
    loud = F.concat(F.upper(F.regexp_extract(url, "^[^/]*//[^/]*", 0)), F.regexp_extract(url, "^[^/]*//[^/]*(.*)$", 1))
    base = F.substring_index(url, "#", 1)
    second = F.when(F.col("page_id") % 6 == 0, F.concat(base, F.lit("/unseen"))).otherwise(
        F.concat(base, F.lit("#part"))
    )
    facts = F.array(
        F.struct(F.lit("sns").alias("topic"), F.lit("seen").alias("fact"), url.alias("source_url")),
        F.struct(F.lit("timing").alias("topic"), F.lit("seen").alias("fact"), second.alias("source_url")),
    )
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"),
        topic.alias("request_id"),
        loud.alias("source_url"),
        page_date().alias("published_at"),
        F.when(F.col("page_id") % 5 != 1, facts).alias("research_facts"),
    )


def _page_evidence(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "pages").where(~F.col("html").contains("casino"))
    return ev.canonical_evidence(seen.select(page_language().alias("request_id"), "url"))


_SQL_GATES = rf"""{SQL_PAGE},
canon AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '\?$', '') AS plain,
         CASE WHEN page_id % 7 = 0 THEN 'en' ELSE lang END AS topic FROM page),
shaped AS (
  SELECT *, CASE WHEN regexp_matches(plain, '^[^/]*//[^/?]*$') THEN plain || '/' ELSE plain END AS link FROM canon),
seen AS (SELECT DISTINCT lang AS topic, link FROM shaped WHERE NOT contains(html, 'casino'))"""


@query(
    f"""WITH {_SQL_GATES}
SELECT c.page_id AS ord FROM shaped c WHERE EXISTS (
  SELECT 1 FROM seen s WHERE s.topic = c.topic AND s.link = c.link)"""
)
def sourced_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """V7 + J9: candidates whose source is in the evidence of their own topic."""
    return ev.gate_source(_page_candidates(spark, folder), _page_evidence(spark, folder)).select("ord")


@query(
    f"""WITH {_SQL_GATES}
SELECT c.page_id AS ord FROM shaped c WHERE c.page_id % 5 = 1 OR (c.page_id % 6 <> 0 AND EXISTS (
  SELECT 1 FROM seen s WHERE s.topic = c.topic AND s.link = c.link))"""
)
def researched_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """V8 + J9: candidates all of whose facts are in the evidence of their own topic."""
    return ev.gate_research(_page_candidates(spark, folder), _page_evidence(spark, folder)).select("ord")


@query(
    f"""WITH {SQL_PAGE}
SELECT page_id AS ord FROM page WHERE published IS NULL OR published <= DATE '{TODAY}'"""
)
def dated_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """V9: candidates not published after today; no date passes."""
    return ev.gate_future(_page_candidates(spark, folder), TODAY).select("ord")


@query(
    r"""SELECT page_id AS ord, CAST(i AS INTEGER) AS fact_no, CASE WHEN page_id % 5 = 1 THEN NULL
         WHEN i = 0 THEN url WHEN page_id % 6 = 0 THEN regexp_replace(url, '#.*$', '') || '/unseen'
         ELSE regexp_replace(url, '#.*$', '') || '#part' END AS source_url
FROM pages, unnest(CASE WHEN page_id % 5 = 1 THEN [NULL] ELSE [0, 1] END) AS u(i)"""
)
def candidate_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per research fact; a candidate without facts keeps an empty row."""
    return ev.explode_facts(_page_candidates(spark, folder)).select("ord", "fact_no", "source_url")


_FAULTS = {
    1: "location",
    2: "unknown_field",
    3: "company_name",
    4: "website",
    7: "research_facts",
    8: "published_at",
    9: "malformed",
    10: "source_url",
    11: "unknown_field",
}


def _document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Raw candidates from whole documents, broken in fourteen ways by document number."""
    kind = F.col("doc_id") % 14
    text = lambda value: F.to_json(F.array(value))  # noqa: E731 - quoting by Spark itself
    quoted = lambda value: F.regexp_replace(text(value), r"^\[|\]$", "")
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example"))
    facts = F.concat(
        F.lit('[{"topic":'),
        F.when(kind == 7, F.lit('"weather"')).otherwise(F.lit('"sns"')),
        F.lit(',"fact":'), quoted(F.col("text")), F.lit(',"source_url":'), quoted(site), F.lit("}]"),
    )
    unknowns = F.when(kind == 12, F.lit('["a","b","c","d","e","f","g"]')).otherwise(F.lit('["a"]'))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    source = F.when(kind == 10, F.lit("ftp://x.example/")).otherwise(
        F.concat(site, F.lit("/"), F.col("doc_id").cast("string"))
    )
    parts = F.array(
        pair("company_name", F.when(kind == 3, F.lit('""')).otherwise(quoted(F.col("source")))),
        pair("website", F.when(kind == 4, F.lit("5")).when(kind == 5, F.lit("null")).otherwise(quoted(site))),
        pair("trigger_type", quoted(F.col("lang"))),
        F.when(kind != 11, pair("trigger_title", quoted(F.concat(F.lit("document "), F.col("doc_id").cast("string"))))),
        pair("trigger_summary", quoted(F.col("text"))),
        pair("published_at", F.when(kind == 8, F.lit('"2024-02-30"')).otherwise(quoted(day))),
        pair("source_url", quoted(source)),
        pair("source_title", F.lit('""')),
        F.when(kind != 1, pair("location", F.lit('"x"'))),
        pair("possible_video_need", F.lit('""')),
        F.when(kind != 13, pair("research_facts", facts)),
        F.when(kind != 13, pair("research_unknowns", unknowns)),
        F.when(kind.isin(2, 11), pair("extra", F.lit("1"))),
    )
    body = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    raw = F.when(kind == 9, F.lit("{broken")).otherwise(body)
    canonical = F.array(F.concat(site, F.lit("/"), F.col("doc_id").cast("string")), F.concat(site, F.lit("/")))
    evidence = F.when(F.col("doc_id") % 5 != 0, canonical).otherwise(F.slice(canonical, 2, 1))
    return spread_table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("topic"), raw.alias("item"), evidence.alias("evidence")
    )


_SQL_CHECKED = f"""
checked AS (
  SELECT doc_id, lang AS topic, length(text) AS n, doc_id % 14 AS kind,
    CASE doc_id % 14 {" ".join(f"WHEN {kind} THEN '{name}'" for kind, name in _FAULTS.items())}
      WHEN 13 THEN NULL
      ELSE CASE WHEN length(text) > 400 OR length(text) = 0 THEN 'research_facts'
                WHEN doc_id % 14 = 12 THEN 'research_unknowns' END END AS fault
  FROM documents),
reviewed AS (
  SELECT *, coalesce(fault, CASE WHEN doc_id % 5 = 0 THEN 'unverified_source'
    WHEN DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) > DATE '{TODAY}' THEN 'future_date' END) AS reject_reason
  FROM checked)"""


@query(f"WITH {_SQL_CHECKED} SELECT doc_id, fault AS reject_reason FROM checked")
def checked_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """V1: closed-schema check of every raw candidate, with the first fault."""
    return va.validate_candidates(_document_items(spark, folder)).select("doc_id", "reject_reason")


@query(f"WITH {_SQL_CHECKED} SELECT doc_id, reject_reason FROM reviewed")
def reviewed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """V1 + V7 + V8 + V9: schema and gates in one pass."""
    return va.review_candidates(_document_items(spark, folder), TODAY).select("doc_id", "reject_reason")


@query(
    f"""WITH {_SQL_CHECKED}
SELECT topic, count(*) FILTER (WHERE reject_reason IS NULL) AS accepted,
       count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected
FROM reviewed GROUP BY topic"""
)
def topic_results(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected per topic."""
    return va.topic_counts(va.review_candidates(_document_items(spark, folder), TODAY))


@query(
    f"""WITH {_SQL_CHECKED}
SELECT topic, 'accepted' AS outcome, count(*) AS n FROM reviewed WHERE reject_reason IS NULL GROUP BY topic
UNION ALL SELECT topic, 'rejected', count(*) FROM reviewed WHERE reject_reason IS NOT NULL GROUP BY topic"""
)
def split_results(spark: SparkSession, folder: str) -> DataFrame:
    """V10 + U1: the accepted rows and the rejected counts, as one union."""
    accepted, rejected = va.split_accept_reject(
        va.review_candidates(_document_items(spark, folder), TODAY).drop("item", "evidence")
    )
    counted = accepted.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("outcome", F.lit("accepted")).unionByName(
        rejected.select("topic", F.lit("rejected").alias("outcome"), F.col("rejected").alias("n"))
    )


def _order_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Discovery outputs with 0 to 12 candidates, some broken."""
    kind, size = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 13).cast("int")
    item = lambda i: F.concat(F.lit('{"no":'), i.cast("string"), F.lit("}"))
    items = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), item)).otherwise(F.array().cast("array<string>"))
    items = F.when(kind == 1, F.concat(items, F.array(F.lit("7")))).otherwise(items)
    body = F.concat(F.lit('{"candidates":['), F.array_join(items, ","), F.lit("]"))
    text = (
        F.when(kind == 2, F.concat(body, F.lit(',"note":1}')))
        .when(kind == 3, F.lit("{}"))
        .when(kind == 4, F.lit("[]"))
        .otherwise(F.concat(body, F.lit("}")))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("text"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'candidates' WHEN 2 THEN 'unknown_field'
         WHEN 3 THEN 'candidates' WHEN 4 THEN 'malformed'
         ELSE CASE WHEN o_orderkey % 13 > 10 THEN 'candidates' END END AS problem
FROM orders"""
)
def discovery_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """V2: whole responses that are invalid, with the reason."""
    return va.validate_discovery_output(_order_outputs(spark, folder)).select("o_orderkey", "problem")


@query(
    """SELECT o_orderkey, CAST(i AS INTEGER) AS item_no, CAST(i + 1 AS BIGINT) AS no
FROM orders, unnest(range(0, o_orderkey % 13)) AS u(i)
WHERE o_orderkey % 6 NOT IN (1, 2, 3, 4) AND o_orderkey % 13 <= 10"""
)
def candidate_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per raw candidate of the valid responses, with its position."""
    valid = va.validate_discovery_output(_order_outputs(spark, folder)).where(F.col("problem").isNull())
    return va.explode_candidates(valid).select(
        "o_orderkey", "item_no", F.get_json_object("item", "$.no").cast("long").alias("no")
    )


_FIELDS = [(stage, name) for stage, names in STAGES.items() for name in names]


def _event_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation texts with one rating taken from the event, in five JSON forms."""
    kind = F.col("event_id") % 6
    k = F.get_json_object("props", "$.k")
    value = (
        F.when(kind <= 1, k)
        .when(kind == 2, F.concat(F.lit('"'), k, F.lit('"')))
        .when(kind == 3, F.concat(k, F.lit(".5")))
        .when(kind == 4, F.lit("true"))
        .otherwise(F.concat(F.lit("-"), k))
    )
    place = F.col("event_id") % len(_FIELDS)
    rated = [
        F.concat(F.lit(f'"{name}":'), F.when(place == i, value).otherwise(F.lit("5")))
        for i, (_, name) in enumerate(_FIELDS)
    ]
    stages = [
        F.concat(F.lit(f'"{stage}":{{'), F.concat_ws(",", *rated[i * 5 : i * 5 + 5]), F.lit("}"))
        for i, stage in enumerate(STAGES)
    ]
    covered = ",".join(f'"{stage}":{{"coverage":"low","reason":"r"}}' for stage in STAGES)
    rest = (
        f'"scope_hypothesis":"s","evidence_coverage":{{{covered}}},"reason":"r","strongest_signals":[],'
        '"risks":["a","b","c"],"research_needed":[]'
    )
    body = F.concat(F.lit("{"), F.concat_ws(",", *stages), F.lit("," + rest + "}"))
    return spread_table(spark, folder, "events").select("event_id", body.alias("text"))


@query(
    f"""SELECT event_id, CASE WHEN (event_id % 6 <= 1 AND k <= 10) OR (event_id % 6 = 5 AND k = 0) THEN NULL
  ELSE CASE event_id % 15 // 5 WHEN 0 THEN 'need' WHEN 1 THEN 'win' ELSE 'deliver' END END AS problem
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def strict_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """V3: evaluations with fifteen strict integers; text, fractions, booleans and bounds are faults."""
    return va.validate_evaluation(_event_evaluations(spark, folder)).select("event_id", "problem")


def _line_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy score texts: numbers as numbers or text, and values that are none."""
    kind = F.col("l_orderkey") % 6
    quantity = F.col("l_quantity").cast("int").cast("string")
    first = (
        F.when(kind == 1, F.concat(F.lit('"'), quantity, F.lit('"')))
        .when(kind == 2, F.lit('"much"'))
        .when(kind == 3, F.lit("1e999"))
        .when(kind == 4, F.lit("null"))
        .otherwise(quantity)
    )
    line = F.col("l_linenumber").cast("string")
    values = [F.concat(F.lit('"video_need":'), first)] + [
        F.concat(F.lit(f'"{name}":'), line) for name in list(DIMENSION_WEIGHTS)[1:]
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *values), F.lit(',"reason":"r","risks":[]'))
    text = F.concat(body, F.when(kind == 5, F.lit(',"more":0}')).otherwise(F.lit("}")))
    return spread_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_orderkey % 6 WHEN 2 THEN 'video_need' WHEN 3 THEN 'video_need' WHEN 4 THEN 'video_need'
                      WHEN 5 THEN 'unknown_field' END AS problem,
  CASE WHEN l_orderkey % 6 <= 1 THEN CAST(least(10, CAST(l_quantity AS INTEGER)) * 2.5e0
       + least(10, l_linenumber) * 7.5e0 AS DOUBLE) END AS total_score
FROM lineitem"""
)
def legacy_scores(spark: SparkSession, folder: str) -> DataFrame:
    """V4 + M1 + M2: legacy scores checked, clamped and added up."""
    checked = va.validate_scores(_line_scores(spark, folder))
    total = weighted_total({name: F.col(name) for name in DIMENSION_WEIGHTS})
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "problem", total.alias("total_score"))


def _customer_strategies(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("c_custkey") % 7
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    pair = lambda field, value: F.concat(F.lit(f'"{field}":'), value)
    proposal = F.concat(
        F.lit('{"title":'), name, F.lit(',"description":"d","deliverables":'),
        F.when(kind == 1, F.lit('"one"')).otherwise(F.lit('["one"]')),
        F.when(kind == 2, F.lit(',"more":1}')).otherwise(F.lit("}")),
    )
    special = {
        "why_now": F.when(kind == 3, F.lit("null")).otherwise(name),
        "proposal": proposal,
        "risks": F.when(kind == 4, F.lit("[1]")).otherwise(F.lit('["r"]')),
        "research_notes": F.lit("[]"),
    }
    fields = [
        pair(field, special.get(field, F.lit('"x"')))
        if field != "sales_angle"
        else F.when(kind != 5, pair(field, F.lit('"x"')))
        for field in records.STRATEGY.fields
    ]
    body = F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.when(kind == 6, F.lit("")).otherwise(F.lit("}")))
    return table(spark, folder, "customer").select("c_custkey", body.alias("text"))


@query(
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'proposal' WHEN 2 THEN 'proposal' WHEN 3 THEN 'why_now'
  WHEN 4 THEN 'risks' WHEN 5 THEN 'sales_angle' WHEN 6 THEN 'malformed' END AS problem,
  CASE WHEN c_custkey % 7 = 0 THEN c_name END AS title
FROM customer"""
)
def strategy_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """V5 + N4: strategies checked, and the valid ones unpacked."""
    typed = va.typed_json(F.col("text"), records.STRATEGY_DDL)
    return (
        va.validate_strategy(_customer_strategies(spark, folder))
        .select("c_custkey", "problem", F.when(F.col("problem").isNull(), typed["proposal"]["title"]).alias("title"))
    )


def _turn_response(text: Column) -> Column:
    status = F.when(F.col("role") == "system", "incomplete").otherwise("completed")
    body = F.when(F.col("role") == "assistant", F.lit('{"candidates":[]}')).otherwise(text)
    page = F.concat_ws("/", F.lit("https://e.example"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return F.to_json(
        F.struct(
            status.alias("status"),
            body.alias("output_text"),
            F.array(
                F.struct(
                    F.lit("web_search_call").alias("type"),
                    F.lit("completed").alias("status"),
                    F.struct(F.lit("open_page").alias("type"), page.alias("url")).alias("action"),
                )
            ).alias("output"),
        )
    )


@query(
    """WITH numbered AS (
  SELECT conv_id, role, turn, CASE conv_id % 4 WHEN 0 THEN turn WHEN 1 THEN turn + 1 WHEN 2 THEN turn * 5 + 3 ELSE turn // 2 END AS attempt
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY attempt, role <> 'assistant', turn) AS place FROM numbered),
tried AS (
  SELECT *, min(place) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS good FROM placed WHERE place <= 3),
used AS (SELECT *, 'https://e.example/' || conv_id || '/' || turn AS url FROM tried WHERE good IS NULL OR place <= good)
SELECT CAST(conv_id AS VARCHAR) AS request_id, count(*) AS attempt_count,
       CASE WHEN any_value(good) IS NOT NULL THEN '{"candidates":[]}' END AS text,
       string_agg(url, ' ' ORDER BY url) AS evidence,
       CASE WHEN any_value(good) IS NULL THEN 'InvalidOutputError' END AS error_type
FROM used GROUP BY conv_id"""
)
def valid_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid of the first three attempts, with the evidence up to it; turns of a talk are attempts. They
    are numbered from 0, from 1, from 3 with gaps, or in pairs that share a number."""
    kind, turn = F.col("conv_id") % 4, F.col("turn")
    number = F.when(kind == 0, turn).when(kind == 1, turn + 1).when(kind == 2, turn * 5 + 3).otherwise(F.floor(turn / 2))
    responses = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("request_id"),
        number.cast("int").alias("attempt"),
        _turn_response(F.col("text")).alias("response"),
    )
    tried = va.attempts_with_problem(responses, records.DISCOVERY)
    return va.last_valid_attempt(tried).withColumn("evidence", F.array_join("evidence", " "))


@query("SELECT o_custkey, o_orderpriority, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Q1: key values held by several rows."""
    return va.check_unique(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"])


@query(
    """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"""
)
def dangling_references(spark: SparkSession, folder: str) -> DataFrame:
    """Q2: rows whose reference does not resolve."""
    known = table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return va.check_reference(table(spark, folder, "orders"), "o_custkey", known, "c_custkey").select("o_orderkey")


@query("SELECT doc_id FROM labels WHERE NOT (quality = 1 OR toxic = 1)")
def invalid_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Q3: ratings outside the vocabulary."""
    rating = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("poor")
    return va.check_rating(table(spark, folder, "labels").withColumn("rating", rating)).select("doc_id")
