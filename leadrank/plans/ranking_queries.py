"""Queries over scores, ranks and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions.fixed import COVERAGE_LEVELS, LABELS, MESSAGE_UNITS, REPORT_TITLE, STAGES
from leadrank.functions.scoring import evaluation_means, evaluation_priority, weighted_total
from leadrank.functions.text import format_g
from leadrank.operators import ranking, report, runs
from leadrank.plans.bindings import (
    SQL_DAY,
    SQL_RANKED,
    SQL_RATINGS,
    SQL_SCORES,
    day_number,
    event_ratings,
    event_scores,
    evaluation_of_event,
    spread_table,
    table,
)
from leadrank.plans.registry import query
from leadrank.session import cut_lineage


@query(
    f"WITH {SQL_RANKED} SELECT run_id, company_id, trigger_id, total_score, selected_rank FROM top"
)
def top_companies(spark: SparkSession, folder: str) -> DataFrame:
    """W1 + W2: the five best companies of each run."""
    return ranking.select_top(event_scores(spark, folder), 5).select(
        "run_id", "company_id", "trigger_id", "total_score", "selected_rank"
    )


@query(f"WITH {SQL_RANKED} SELECT run_id, company_id, trigger_id, total_score FROM best")
def best_triggers(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest trigger of each company in each run."""
    return ranking.best_trigger_per_company(event_scores(spark, folder)).select(
        "run_id", "company_id", "trigger_id", "total_score"
    )


@query(
    f"""WITH {SQL_RANKED}
SELECT s.id, s.run_id, s.company_id, s.total_score, t.selected_rank
FROM scores s LEFT JOIN top t ON t.id = s.id"""
)
def ranked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every score row with its stored rank, null where not selected."""
    return ranking.rank_scores(event_scores(spark, folder), 5).select(
        "id", "run_id", "company_id", "total_score", "selected_rank"
    )


@query(
    f"""WITH {SQL_RANKED}, {SQL_RATINGS}
SELECT t.run_id, CAST(count(*) FILTER (WHERE r.rating = 'good') AS DOUBLE) / count(*) AS precision_at_5
FROM top t LEFT JOIN ratings r ON r.run_id = t.run_id AND r.company_id = t.company_id
GROUP BY t.run_id HAVING count(*) = 5 AND count(r.id) = 5"""
)
def precision_at_5(spark: SparkSession, folder: str) -> DataFrame:
    """A4 + J8: share of good ratings among the top five of each fully rated run."""
    top = ranking.select_top(event_scores(spark, folder), 5)
    return ranking.precision_at_k(top, event_ratings(spark, folder), 5)


@query(
    f"""WITH {SQL_RANKED}, {SQL_RATINGS}
SELECT s.model, s.prompt_version, count(*) AS scored, round(avg(s.total_score), 6) AS mean_total,
       count(t.id) AS ranked, count(t.id) FILTER (WHERE r.id IS NOT NULL) AS rated,
       CASE WHEN count(t.id) FILTER (WHERE r.id IS NOT NULL) > 0
            THEN CAST(count(t.id) FILTER (WHERE r.rating = 'good') AS DOUBLE)
                 / count(t.id) FILTER (WHERE r.id IS NOT NULL) END AS good_share
FROM scores s LEFT JOIN top t ON t.id = s.id
LEFT JOIN ratings r ON r.run_id = s.run_id AND r.company_id = s.company_id
GROUP BY s.model, s.prompt_version"""
)
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """A5: scores and ratings by model and prompt version."""
    ranked = ranking.rank_scores(event_scores(spark, folder), 5)
    return ranking.compare_models(ranked, event_ratings(spark, folder)).withColumn(
        "mean_total", F.round("mean_total", 6)
    )


@query(f"WITH {SQL_SCORES} SELECT id, need, win, deliver, total_score FROM scores")
def stage_priorities(spark: SparkSession, folder: str) -> DataFrame:
    """M3 + M4: stage means and priority of every event."""
    evaluated = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), evaluation_of_event().alias("evaluation")
    )
    means = evaluation_means(F.col("evaluation"))
    return evaluated.select(
        "id",
        *[means[stage].alias(stage) for stage in STAGES],
        evaluation_priority(F.col("evaluation")).alias("total_score"),
    )


@query(
    f"""WITH {SQL_RANKED}
SELECT run_id, company_id, trigger_id, selected_rank, need AS need_mean, win AS win_mean,
       deliver AS deliver_mean,
       {", ".join(
           f"CASE (id + {i}) % 3 WHEN 0 THEN '{COVERAGE_LEVELS[0]}' WHEN 1 THEN '{COVERAGE_LEVELS[1]}' "
           f"ELSE '{COVERAGE_LEVELS[2]}' END AS {stage}_coverage"
           for i, stage in enumerate(STAGES))}
FROM top"""
)
def stage_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Stage means and coverage of the ranked rows."""
    top = _top_events(spark, folder)
    return ranking.stage_summary(top.withColumn("evaluation_json", evaluation_of_event()))


def _top_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events selected into a top five, with their rank.

    Ranking sees narrow rows only. The selected ones, written once so that their size is known, then fetch
    their payload; what is not selected never carries any.
    """
    scores = event_scores(spark, folder).select("run_id", "company_id", "trigger_id", "total_score")
    top = cut_lineage(ranking.select_top(scores, 5))
    events = table(spark, folder, "events").withColumn("trigger_id", F.col("event_id"))
    return events.join(top, "trigger_id")


_DIMENSIONS = {
    "video_need": ("l_quantity / 5.0", "l_quantity / 5.0"),
    "timing": ("l_extendedprice / 5000.0 - 2.0", "l_extendedprice / 5000.0 - 2.0"),
    "budget_fit": ("l_discount * 120.0 - 1.0", "l_discount * 120.0 - 1.0"),
    "studio_fit": ("l_tax * 150.0 - 1.0", "l_tax * 150.0 - 1.0"),
    "entry_chance": ("l_linenumber * 2.0", "l_linenumber * 2.0"),
    "location_fit": ("l_partkey % 13 - 1.0", "l_partkey % 13 - 1.0"),
}


def _quarters(expression: str) -> str:
    # Quarter steps keep every total exact in binary, so both engines round the same number.
    return f"floor(CAST({expression} AS DOUBLE) * 4e0) / 4e0"


def _sql_clamped(expression: str) -> str:
    return f"greatest(0, least(10, {_quarters(expression)}))"


_SQL_WEIGHTED = " + ".join(
    f"{weight} * {_sql_clamped(_DIMENSIONS[name][0])}"
    for name, weight in zip(_DIMENSIONS, ("2.5e0", "2e0", "1.5e0", "1.5e0", "1.5e0", "1e0"))
)


def line_dimensions() -> dict:
    """Six dimensions per line item, some below 0 or above 10; returned items have no valid timing."""
    columns = {
        name: F.expr(_quarters(expression.replace(".0", "e0"))) for name, (expression, _) in _DIMENSIONS.items()
    }
    columns["timing"] = F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(columns["timing"])
    return columns


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_returnflag <> 'R' THEN round({_SQL_WEIGHTED.replace('.0', 'e0')}, 2) END AS total_score
FROM lineitem"""
)
def weighted_totals(spark: SparkSession, folder: str) -> DataFrame:
    """M1 + M2: legacy total of every line item; a value that is not finite makes it null."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", weighted_total(line_dimensions()).alias("total_score")
    )


# Sevenths fill all binary digits of a total; quarters give totals that lie on a tie.
_SEVENTHS = {name: f"(CAST({expression} AS DOUBLE)) / 7e0" for name, (expression, _) in _DIMENSIONS.items()}
_SQL_EXACT = " + ".join(
    f"{weight} * greatest(0, least(10, CASE WHEN l_returnflag = 'A' THEN {_quarters(_DIMENSIONS[name][0])} "
    f"ELSE {_SEVENTHS[name]} END))"
    for name, weight in zip(_DIMENSIONS, ("2.5e0", "2e0", "1.5e0", "1.5e0", "1.5e0", "1e0"))
)


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(format('{{:.2f}}', CAST({_SQL_EXACT.replace('.0', 'e0')} AS DOUBLE)) AS DOUBLE) AS total_score
FROM lineitem"""
)
def exact_totals(spark: SparkSession, folder: str) -> DataFrame:
    """M2 as earlier runs stored it: totals rounded from their exact binary value, ties among them."""
    spark_sql = lambda expression: F.expr(expression.replace(".0", "e0"))
    dimensions = {
        name: F.when(F.col("l_returnflag") == "A", spark_sql(_quarters(_DIMENSIONS[name][0]))).otherwise(
            spark_sql(_SEVENTHS[name])
        )
        for name in _DIMENSIONS
    }
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", weighted_total(dimensions, "python").alias("total_score")
    )


@query(
    "SELECT o_orderkey, printf('%g', (o_orderkey * 7 + o_custkey) % 10001 / 100) AS score_text FROM orders"
)
def score_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest text of a score."""
    score = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 10001) / F.lit(100.0)
    return table(spark, folder, "orders").select("o_orderkey", format_g(score).alias("score_text"))


def _hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the hour as their run."""
    return table(spark, folder, "events").withColumn(
        "run_id", F.unix_date(F.col("ts").cast("date")).cast("long") * 24 + F.hour("ts")
    ).withColumn("company_id", F.col("user_id"))


def _run_parts(spark: SparkSession, folder: str, run: Column | None = None) -> dict[str, DataFrame]:
    hourly = _hourly(spark, folder)
    if run is not None:
        hourly = hourly.withColumn("run_id", run)
    stage = F.when(F.col("event_id") % 3 == 0, "discovery").when(F.col("event_id") % 3 == 1, "scoring")
    return {
        "runs": hourly.select("run_id").distinct(),
        "observed": hourly,
        "scores": hourly.where(F.col("event_type").isin("purchase", "signup")),
        "strategies": hourly.where(F.col("event_type") == "purchase"),
        "errors": hourly.where(F.col("event_type") == "error").select(
            "run_id",
            F.col("event_id").alias("ord"),
            stage.otherwise("strategy").alias("stage"),
            F.when(F.col("value") > 40, "RuntimeError").otherwise("ValueError").alias("error_type"),
            (F.col("value") > 40).alias("fatal"),
        ),
    }


_SQL_HOURLY = f"""
hourly AS (SELECT *, {SQL_DAY} * 24 + hour(ts) AS run_id FROM events),
runs AS (SELECT DISTINCT run_id FROM hourly),
errors AS (
  SELECT run_id, event_id AS ord, value > 40 AS fatal,
         CASE event_id % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'scoring' ELSE 'strategy' END || ': ' ||
         CASE WHEN value > 40 THEN 'RuntimeError' ELSE 'ValueError' END AS message
  FROM hourly WHERE event_type = 'error'),
messages AS (SELECT run_id, string_agg(message, '; ' ORDER BY ord) AS error_message FROM errors GROUP BY run_id),
states AS (
  SELECT r.run_id, CASE WHEN bool_or(e.fatal) THEN 'failed' WHEN count(e.ord) > 0 THEN 'partial'
                        ELSE 'completed' END AS status
  FROM runs r LEFT JOIN errors e ON e.run_id = r.run_id GROUP BY r.run_id)"""


@query(
    f"""WITH {_SQL_HOURLY}
SELECT run_id, count(DISTINCT user_id) AS candidate_count,
       count(DISTINCT user_id) FILTER (WHERE event_type IN ('purchase', 'signup')) AS scored_count,
       count(*) FILTER (WHERE event_type = 'purchase') AS strategy_count
FROM hourly GROUP BY run_id"""
)
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A1 + A2 + A3: companies seen, companies scored, strategies saved per run."""
    parts = _run_parts(spark, folder)
    return (
        runs.candidate_count(parts["observed"])
        .join(runs.scored_count(parts["scores"]), "run_id", "left")
        .join(runs.strategy_count(parts["strategies"]), "run_id", "left")
        .fillna(0)
    )


@query(f"WITH {_SQL_HOURLY} SELECT run_id, status FROM states")
def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """Failed, partial or completed."""
    parts = _run_parts(spark, folder)
    return runs.run_status(parts["runs"], parts["errors"])


@query(f"WITH {_SQL_HOURLY} SELECT run_id, error_message FROM messages")
def run_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The errors of a run in order, as one text."""
    return runs.error_messages(_run_parts(spark, folder)["errors"])


@query(
    f"""WITH {_SQL_HOURLY}
SELECT s.run_id, s.status, count(DISTINCT h.user_id) AS candidate_count,
       count(DISTINCT h.user_id) FILTER (WHERE h.event_type IN ('purchase', 'signup')) AS scored_count,
       count(*) FILTER (WHERE h.event_type = 'purchase') AS strategy_count,
       any_value(m.error_message) AS error_message
FROM states s JOIN hourly h ON h.run_id = s.run_id LEFT JOIN messages m ON m.run_id = s.run_id
GROUP BY s.run_id, s.status"""
)
def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The final row of each run."""
    return runs.run_summary(**_run_parts(spark, folder))


@query(
    f"""WITH {_SQL_HOURLY}
SELECT s.run_id, '# Sales Report Error' || chr(10) || 'Run: ' || s.run_id || chr(10) || 'Status: ' || s.status
       || chr(10) || chr(10) || '{LABELS["error_intro"]}' || chr(10) || '{LABELS["bullet"]}'
       || replace(m.error_message, '; ', chr(10) || '{LABELS["bullet"]}') AS report
FROM states s JOIN messages m ON m.run_id = s.run_id"""
)
def error_reports(spark: SparkSession, folder: str) -> DataFrame:
    """R2: an alert per run with errors."""
    parts = _run_parts(spark, folder)
    return report.format_error_report(
        runs.run_status(parts["runs"], parts["errors"]), runs.error_messages(parts["errors"])
    )


# All errors of the table in two runs, so that one alert has many pieces.
_SQL_LONG_RUNS = _SQL_HOURLY.replace(f"{SQL_DAY} * 24 + hour(ts)", f"{SQL_DAY} % 2")


@query(
    f"""WITH {_SQL_LONG_RUNS},
alerts AS (
  SELECT s.run_id, '# Sales Report Error' || chr(10) || 'Run: ' || s.run_id || chr(10) || 'Status: ' || s.status
         || chr(10) || chr(10) || '{LABELS["error_intro"]}' || chr(10) || '{LABELS["bullet"]}'
         || replace(m.error_message, '; ', chr(10) || '{LABELS["bullet"]}') AS report
  FROM states s JOIN messages m ON m.run_id = s.run_id)
SELECT run_id, i AS chunk_no, substr(report, i * {MESSAGE_UNITS} + 1, {MESSAGE_UNITS}) AS chunk
FROM alerts, unnest(range(0, CAST(ceil(length(report) / {MESSAGE_UNITS}.0) AS BIGINT))) AS u(i)"""
)
def alert_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """R2 + R3: alerts of runs with very many errors, in pieces, from error rows."""
    parts = _run_parts(spark, folder, day_number(F.col("ts")) % 2)
    return report.error_report_pieces(runs.run_status(parts["runs"], parts["errors"]), parts["errors"])


@query(
    """SELECT user_id AS company_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM events GROUP BY user_id"""
)
def seen_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A10: first and last sighting of each company."""
    seen = runs.seen_range(
        table(spark, folder, "events").select(F.col("user_id").alias("company_id"), F.col("ts").alias("seen_at"))
    )
    text = "yyyy-MM-dd HH:mm:ss"
    return seen.select(
        "company_id",
        F.date_format("first_seen_at", text).alias("first_seen"),
        F.date_format("last_seen_at", text).alias("last_seen"),
    )


def _report_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked rows with their candidates, and strategies for the users that ever purchased that day."""
    events = table(spark, folder, "events")
    ranked = _top_events(spark, folder).select(
        "trigger_id",
        "run_id",
        "company_id",
        "total_score",
        "selected_rank",
        evaluation_of_event().alias("evaluation_json"),
        F.struct(
            F.concat(F.lit("Company "), F.col("user_id").cast("string")).alias("company_name"),
            F.concat(F.lit("Event "), F.col("event_type")).alias("trigger_title"),
            F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")).alias("source_url"),
        ).alias("candidate_json"),
    )
    text = lambda prefix: F.concat(F.lit(prefix), F.col("event_type"))
    strategies = events.where(F.col("event_type") != "error").select(
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"),
        F.col("event_id").alias("trigger_id"),
        F.struct(
            text("now ").alias("why_now"),
            F.struct(
                text("title ").alias("title"),
                text("film ").alias("description"),
                F.array(text("cut ")).alias("deliverables"),
            ).alias("proposal"),
            text("price ").alias("estimated_budget"),
            text("dept ").alias("target_department"),
            text("role ").alias("target_role"),
            text("form ").alias("first_contact_method"),
            text("angle ").alias("sales_angle"),
            F.array(text("doubt ")).alias("risks"),
        ).alias("content_json"),
    )
    run_rows = (
        events.groupBy(F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"))
        .agg(
            F.countDistinct("user_id").alias("candidate_count"),
            F.countDistinct("user_id").alias("scored_count"),
            F.count_if(F.col("event_type") != "error").alias("strategy_count"),
        )
        .withColumn("status", F.lit("completed"))
        .withColumn("day", F.date_from_unix_date(F.col("run_id").cast("int")))
    )
    return run_rows, ranked, strategies


def _sql_stage_line(stage: str, number: int) -> str:
    level = (
        f"CASE (t.id + {number}) % 3 WHEN 0 THEN '{COVERAGE_LEVELS[0]}' WHEN 1 THEN '{COVERAGE_LEVELS[1]}' "
        f"ELSE '{COVERAGE_LEVELS[2]}' END"
    )
    return (
        f"'{stage.upper()}: ' || printf('%g', t.{stage}) || '/10 / {LABELS['coverage']}' || {level}, "
        f"'seen in ' || t.model"
    )


_SQL_ENTRY = f"""concat_ws(chr(10), '', '## ' || t.selected_rank || '. Company ' || t.company_id,
  'Score: ' || printf('%g', t.total_score) || ' / 100', '', '{LABELS["trigger"]}', 'Event ' || t.model,
  '{LABELS["reference_score"]}', 'scope ' || t.id,
  {", ".join(_sql_stage_line(stage, i) for i, stage in enumerate(STAGES))},
  '{LABELS["risks"]}', 'risk of ' || t.model, '{LABELS["follow_up"]}',
  CASE WHEN t.model = 'error' THEN '{LABELS["strategy_failed"]}' ELSE concat_ws(chr(10),
    '', '{LABELS["why_now"]}', 'now ' || t.model, '', '{LABELS["proposal"]}', 'title ' || t.model,
    'film ' || t.model, '{LABELS["bullet"]}cut ' || t.model, '', '{LABELS["price"]}', 'price ' || t.model, '',
    '{LABELS["contact"]}', 'dept ' || t.model || ' / role ' || t.model, 'form ' || t.model, '',
    '{LABELS["angle"]}', 'angle ' || t.model, '', '{LABELS["risks"]}', '{LABELS["bullet"]}doubt ' || t.model) END,
  '', 'Source:', 'https://e.example/' || t.id)"""


@query(
    f"""WITH {SQL_RANKED},
entries AS (
  SELECT t.run_id, count(*) AS n, string_agg({_SQL_ENTRY}, chr(10) ORDER BY t.selected_rank) AS body
  FROM top t GROUP BY t.run_id),
run_rows AS (
  SELECT run_id, count(DISTINCT company_id) AS companies, count(*) FILTER (WHERE model <> 'error') AS made
  FROM scores GROUP BY run_id)
SELECT r.run_id, concat_ws(chr(10), '{REPORT_TITLE}', CAST(DATE '1970-01-01' + CAST(r.run_id AS INTEGER) AS VARCHAR),
  'Run: ' || r.run_id || ' / completed', '{LABELS["explored"]}' || r.companies,
  '{LABELS["evaluated"]}' || r.companies, '{LABELS["ranked"]}' || e.n, '{LABELS["strategies"]}' || r.made,
  e.body) AS report
FROM run_rows r JOIN entries e ON e.run_id = r.run_id"""
)
def run_reports(spark: SparkSession, folder: str) -> DataFrame:
    """R1 + J6 + J7: the report text of each run; a missing strategy leaves a failure note."""
    run_rows, ranked, strategies = _report_inputs(spark, folder)
    return report.format_report(run_rows, report.strategies_of(ranked, strategies))


@query(
    f"""WITH {SQL_RANKED}
SELECT t.run_id, t.selected_rank, t.trigger_id, 'Company ' || t.company_id AS company_name,
       CASE WHEN t.model <> 'error' THEN 'title ' || t.model END AS proposal_title
FROM top t"""
)
def selected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """J6 + J7: selected scores with their candidate and, where generated, their strategy."""
    _, ranked, strategies = _report_inputs(spark, folder)
    return report.strategies_of(ranked, strategies).select(
        "run_id",
        "selected_rank",
        "trigger_id",
        F.col("candidate_json.company_name").alias("company_name"),
        F.col("strategy_json.proposal.title").alias("proposal_title"),
    )


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, i * 100 + 1, 100) AS chunk
FROM documents, unnest(range(0, CAST(ceil(length(text) / 100.0) AS BIGINT))) AS u(i)"""
)
def message_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in pieces of at most 100 UTF-16 units."""
    return report.split_messages(spread_table(spark, folder, "documents"), "text", ["doc_id"], 100)
