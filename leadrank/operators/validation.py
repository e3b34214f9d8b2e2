"""Closed-schema validation of responses and candidates, and table constraints as queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.functions import records
from leadrank.functions.fixed import DIMENSION_WEIGHTS, HUMAN_RATINGS, OUTPUT_TRIES
from leadrank.functions.scoring import clamp
from leadrank.functions.shape import Closed
from leadrank.operators.evidence import (
    evidence_array,
    gate_reason,
    parse_response,
    response_completed,
    response_text,
)
from leadrank.session import cut_lineage


def with_problem(rows: DataFrame, text: str, shape: Closed, name: str = "problem") -> DataFrame:
    """Adds the first fault of a JSON text column against a closed shape, null if it is valid."""
    return shape.with_problem(rows, text, name).drop("_typed")


def validate_discovery_output(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Whole responses: an object with only `candidates`, an array of at most ten objects."""
    return with_problem(outputs, text, records.DISCOVERY)


def validate_evaluation(outputs: DataFrame, text: str = "text") -> DataFrame:
    return with_problem(outputs, text, records.EVALUATION)


def validate_strategy(outputs: DataFrame, text: str = "text") -> DataFrame:
    return with_problem(outputs, text, records.STRATEGY)


def validate_scores(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Legacy scores: adds `problem` and the six clamped dimensions, null where the text is invalid."""
    checked = records.LEGACY_SCORES.with_problem(outputs, text, "problem", "_typed")
    numbers = {}
    for name in DIMENSION_WEIGHTS:
        written = F.col("_typed")[name]
        flag = F.when(written == "true", 1.0).when(written == "false", 0.0)
        numbers[name] = F.when(F.col("problem").isNull(), clamp(F.coalesce(written.try_cast("double"), flag)))
    return checked.withColumns(numbers).drop("_typed")


def typed_json(text: Column, ddl: str) -> Column:
    """Valid JSON text as a typed struct."""
    return F.from_json(text, ddl)


def explode_candidates(outputs: DataFrame, text: str = "text") -> DataFrame:
    """One row per raw candidate, as JSON text, with its position in the response; other columns are kept."""
    keep = [name for name in outputs.columns if name != text]
    items = F.from_json(F.col(text), records.DISCOVERY.ddl)["candidates"]
    return outputs.select(*keep, F.posexplode(items).alias("item_no", "item"))


def validate_candidates(items: DataFrame, item: str = "item") -> DataFrame:
    """Adds `reject_reason` and the typed struct `candidate` (null where rejected)."""
    checked = records.CANDIDATE.with_problem(items, item, "reject_reason", "_typed")
    values = F.col("_typed")
    typed = {
        **{name: values[name] for name in records.CANDIDATE_FIELDS},
        "published_at": values["published_at"].try_cast("date"),
        "discovered_at": values["discovered_at"].try_cast("timestamp"),
        "research_facts": F.coalesce(values["research_facts"], F.array().cast(f"array<{records.FACT_DDL}>")),
        "research_unknowns": F.coalesce(values["research_unknowns"], F.array().cast("array<string>")),
    }
    struct = F.struct(*[column.alias(name) for name, column in typed.items()])
    return checked.withColumn("candidate", F.when(F.col("reject_reason").isNull(), struct)).drop("_typed")


def review_candidates(items: DataFrame, today: date | Column, evidence: str = "evidence") -> DataFrame:
    """Schema check and all gates in one pass without a shuffle; `evidence` is a canonical array column."""
    checked = validate_candidates(items)
    gate = gate_reason(F.col("candidate"), F.col(evidence), today)
    return checked.withColumn("reject_reason", F.coalesce("reject_reason", gate))


def split_accept_reject(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the rejected count per topic (topics without rejection are absent).

    The review is written once; both results read it from there.
    """
    reviewed = cut_lineage(reviewed)
    accepted = reviewed.where(F.col("reject_reason").isNull())
    rejected = (
        reviewed.where(F.col("reject_reason").isNotNull())
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
    return accepted, rejected


def topic_counts(reviewed: DataFrame) -> DataFrame:
    """Accepted and rejected candidates per topic."""
    return reviewed.groupBy("topic").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )


def attempts_with_problem(responses: DataFrame, shape: Closed) -> DataFrame:
    """Raw attempts with `text`, row-local `evidence` and the fault of the output."""
    parsed = responses.withColumn("parsed", parse_response(F.col("response"))).select(
        "request_id",
        "attempt",
        response_text(F.col("parsed")).alias("text"),
        evidence_array(F.col("parsed")).alias("evidence"),
        response_completed(F.col("parsed")).alias("completed"),
    )
    checked = with_problem(parsed, "text", shape, "fault")
    problem = F.when(F.col("completed"), F.col("fault")).otherwise("not_completed")
    return checked.select("request_id", "attempt", "text", "evidence", problem.alias("problem"))


def last_valid_attempt(attempts: DataFrame, tries: int = OUTPUT_TRIES) -> DataFrame:
    """Per request the first valid of its first `tries` attempts, with the evidence seen up to it.

    `attempts` has request_id, attempt, text, evidence and problem. Attempts count in the order of their numbers, wherever
    these start and whatever they leave out; of several with one number a valid one comes first, then the smallest text.
    Every request of the input gets a row. One without a valid attempt gets `error_type` and keeps the evidence of all its
    tries. The first places of a request are kept in the map tasks already, so no task sees more than `tries` rows of it
    from each of them.
    """
    order = Window.partitionBy("request_id").orderBy("attempt", F.col("problem").isNotNull(), "text", "evidence")
    tried = attempts.withColumn("_try", F.row_number().over(order)).where(F.col("_try") <= tries)
    one = F.struct(F.col("_try").alias("place"), "text", "evidence", F.col("problem").isNull().alias("valid"))
    listed = tried.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("_tries"))
    valid = F.filter("_tries", lambda one: one["valid"])
    used = F.filter("_tries", lambda one: F.col("_last").isNull() | (one["place"] <= F.col("_last")))
    return (
        listed.withColumn("_last", F.get(valid, F.lit(0))["place"])
        .withColumn("_used", used)
        .select(
            "request_id",
            F.size("_used").cast("long").alias("attempt_count"),
            F.get(valid, F.lit(0))["text"].alias("text"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("_used", lambda one: one["evidence"])))).alias("evidence"),
            F.when(F.col("_last").isNull(), F.lit("InvalidOutputError")).alias("error_type"),
        )
    )


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; nulls never collide."""
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def check_reference(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference does not resolve."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def check_rating(ratings: DataFrame, column: str = "rating") -> DataFrame:
    """Rows whose rating is outside the vocabulary."""
    return ratings.where(~F.coalesce(F.col(column).isin(*HUMAN_RATINGS), F.lit(False)))
