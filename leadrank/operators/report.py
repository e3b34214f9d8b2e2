"""Text reports: one block per ranked company, one text per run, pieces that fit a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadrank.functions.fixed import ERROR_TITLE, LABELS, MESSAGE_UNITS, REPORT_TITLE, STAGES
from leadrank.functions.scoring import evaluation_means
from leadrank.functions.text import format_g, message_pieces
from leadrank.operators.row_texts import split_rows


def _lines(*values: Column | str) -> Column:
    return F.array(*[F.lit(value) if isinstance(value, str) else value for value in values])


def _bullets(items: Column) -> Column:
    return F.transform(items, lambda item: F.concat(F.lit(LABELS["bullet"]), item))


def _evaluation_lines(evaluation: Column) -> Column:
    means = evaluation_means(evaluation)
    lines = [F.lit(LABELS["reference_score"]), evaluation["scope_hypothesis"]]
    for stage in STAGES:
        cover = evaluation["evidence_coverage"][stage]
        lines += [
            F.concat(
                F.lit(f"{stage.upper()}: "),
                format_g(means[stage]),
                F.lit(f"/10 / {LABELS['coverage']}"),
                cover["coverage"],
            ),
            cover["reason"],
        ]
    return F.concat(
        F.array(*lines),
        _lines(LABELS["risks"]),
        evaluation["risks"],
        _lines(LABELS["follow_up"]),
        evaluation["research_needed"],
    )


def _strategy_lines(strategy: Column) -> Column:
    proposal = strategy["proposal"]
    contact = F.concat(strategy["target_department"], F.lit(" / "), strategy["target_role"])
    return F.concat(
        _lines("", LABELS["why_now"], strategy["why_now"], "", LABELS["proposal"]),
        F.array(proposal["title"], proposal["description"]),
        _bullets(proposal["deliverables"]),
        _lines("", LABELS["price"], strategy["estimated_budget"], "", LABELS["contact"], contact),
        _lines(strategy["first_contact_method"], "", LABELS["angle"], strategy["sales_angle"]),
        _lines("", LABELS["risks"]),
        _bullets(strategy["risks"]),
    )


def report_entry(strategy_skipped: bool) -> Column:
    """Report block of one ranked row with candidate_json, total_score, evaluation_json and strategy_json.

    Legacy rows have no evaluation (null) and get none of its lines.
    """
    candidate, evaluation = F.col("candidate_json"), F.col("evaluation_json")
    none = F.array().cast("array<string>")
    failed = none if strategy_skipped else _lines(LABELS["strategy_failed"])
    lines = F.concat(
        _lines(
            "",
            F.concat(
                F.lit("## "), F.col("selected_rank").cast("string"), F.lit(". "), candidate["company_name"]
            ),
            F.concat(F.lit("Score: "), format_g(F.col("total_score")), F.lit(" / 100")),
            "",
            LABELS["trigger"],
            candidate["trigger_title"],
        ),
        F.when(evaluation.isNotNull(), _evaluation_lines(evaluation)).otherwise(none),
        F.when(F.col("strategy_json").isNotNull(), _strategy_lines(F.col("strategy_json"))).otherwise(failed),
        _lines("", "Source:", candidate["source_url"]),
    )
    return F.array_join(lines, "\n")


def strategies_of(ranked: DataFrame, strategies: DataFrame) -> DataFrame:
    """Ranked rows with `strategy_json`, null where the generation failed or was skipped.

    Ranked rows are few per run: their keys pick the strategies before the wide contents are shuffled.
    """
    keys = ["run_id", "trigger_id"]
    content = strategies.select(*keys, F.col("content_json").alias("strategy_json"))
    return ranked.join(content.join(ranked.select(*keys), keys, "left_semi"), keys, "left")


def format_report(
    runs: DataFrame, ranked: DataFrame, strategy_skipped: bool = False, title: str = REPORT_TITLE
) -> DataFrame:
    """One report text per run.

    `runs`: run_id, day, status and the three counts. `ranked`: rows for `report_entry`, at most k per run,
    which bounds what is gathered into one text.
    """
    entries = (
        ranked.select("run_id", "selected_rank", report_entry(strategy_skipped).alias("entry"))
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("selected_rank", "entry"))).alias("entries"))
    )
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("string")
    ranked_count = F.coalesce(F.size("entries"), F.lit(0))
    header = F.array(
        F.lit(title),
        F.col("day").cast("string"),
        F.concat(F.lit("Run: "), F.col("run_id").cast("string"), F.lit(" / "), F.col("status")),
        F.concat(F.lit(LABELS["explored"]), number("candidate_count")),
        F.concat(F.lit(LABELS["evaluated"]), number("scored_count")),
        F.concat(
            F.lit(LABELS["ranked"]),
            F.when(F.col("entries").isNull(), 0).otherwise(ranked_count).cast("string"),
        ),
        F.concat(F.lit(LABELS["strategies"]), number("strategy_count")),
    )
    blocks = F.coalesce(
        F.transform("entries", lambda item: item["entry"]), F.array().cast("array<string>")
    )
    return runs.join(entries, "run_id", "left").select(
        "run_id", F.array_join(F.concat(header, blocks), "\n").alias("report")
    )


def format_error_report(runs: DataFrame, messages: DataFrame, title: str = ERROR_TITLE) -> DataFrame:
    """One alert per run with errors; it lists stages and error classes, never error texts.

    `runs`: run_id, status. `messages`: run_id and error_message as made by `error_messages`.
    """
    bullets = F.concat(
        F.lit(LABELS["bullet"]), F.replace("error_message", F.lit("; "), F.lit("\n" + LABELS["bullet"]))
    )
    lines = [
        F.lit(title),
        F.concat(F.lit("Run: "), F.col("run_id").cast("string")),
        F.concat(F.lit("Status: "), F.col("status")),
        F.lit(""),
        F.lit(LABELS["error_intro"]),
        bullets,
    ]
    alerts = messages.select("run_id", "error_message").where(F.col("error_message").isNotNull())
    return runs.select("run_id", "status").join(alerts, "run_id").select(
        "run_id", F.array_join(F.array(*lines), "\n").alias("report")
    )


def error_report_rows(runs: DataFrame, errors: DataFrame, title: str = ERROR_TITLE) -> DataFrame:
    """The text of `format_error_report` as rows (run_id, line_kind, ord, text), for `split_rows` in this order.

    `runs`: run_id, status. `errors`: run_id, ord, stage, error_type. A run may have any number of errors; only the head of
    an alert is made per run.
    """
    head = F.array_join(
        F.array(
            F.lit(title),
            F.concat(F.lit("Run: "), F.col("run_id").cast("string")),
            F.concat(F.lit("Status: "), F.col("status")),
            F.lit(""),
            F.lit(LABELS["error_intro"]),
        ),
        "\n",
    )
    heads = runs.join(errors.select("run_id").distinct(), "run_id").select(
        "run_id", F.lit(0).alias("line_kind"), F.lit(0).cast("long").alias("ord"), head.alias("text")
    )
    line = F.concat(F.lit("\n" + LABELS["bullet"]), F.concat_ws(": ", "stage", "error_type"))
    lines = errors.join(runs.select("run_id"), "run_id").select(
        "run_id", F.lit(1).alias("line_kind"), F.col("ord").cast("long").alias("ord"), line.alias("text")
    )
    return heads.unionByName(lines)


def error_report_pieces(runs: DataFrame, errors: DataFrame, limit: int = MESSAGE_UNITS, **options) -> DataFrame:
    """Rows (run_id, chunk_no, chunk): the alerts of `format_error_report` in pieces, without the alert as one value."""
    return split_rows(error_report_rows(runs, errors), ["line_kind", "ord"], limit, **options)


def split_messages(
    texts: DataFrame, text: str, keys: list[str], limit: int = MESSAGE_UNITS
) -> DataFrame:
    """Rows (keys, chunk_no, chunk): pieces of at most `limit` UTF-16 units that add up to the text.

    Pieces leave the worker some thousand at a time, so that it never holds those of a whole batch.
    """
    named = texts.select(*keys, F.col(text).alias("__text"))
    fields = [T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    return named.mapInArrow(message_pieces(limit), T.StructType([*named.schema.fields[:-1], *fields]))
