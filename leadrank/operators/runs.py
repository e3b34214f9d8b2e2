"""Run counters, status, error text and the summary row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadrank.operators.ids import BLOCK_WIDTH, arrival_block


def candidate_count(observed: DataFrame) -> DataFrame:
    """Distinct companies observed per run, known ones included."""
    return observed.groupBy("run_id").agg(F.countDistinct("company_id").alias("candidate_count"))


def scored_count(scores: DataFrame) -> DataFrame:
    """Distinct companies with a score per run; a company may have several scores."""
    return scores.groupBy("run_id").agg(F.countDistinct("company_id").alias("scored_count"))


def strategy_count(strategies: DataFrame) -> DataFrame:
    return strategies.groupBy("run_id").agg(F.count(F.lit(1)).alias("strategy_count"))


def seen_range(sightings: DataFrame, key: str = "company_id", at: str = "seen_at") -> DataFrame:
    """First and last sighting per company."""
    return sightings.groupBy(key).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at")
    )


def error_messages(errors: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """`stage: Type` of each error of a run, in order, joined by `; `.

    `errors` has run_id, ord, stage and error_type. Texts are joined in blocks of the arrival order first, so
    no task sorts all errors of a large run; the second step only joins the block texts.
    """
    message = F.concat_ws(": ", "stage", "error_type")
    blocks = (
        errors.withColumn("block", arrival_block("ord", width))
        .groupBy("run_id", "block")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("ord", message.alias("message")))),
                    lambda item: item["message"],
                ),
                "; ",
            ).alias("part")
        )
    )
    return blocks.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda item: item["part"]),
            "; ",
        ).alias("error_message")
    )


def run_status(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """`failed` if the run aborted, `partial` if it has any error, else `completed`.

    `runs` has run_id; `errors` has run_id and `fatal`.
    """
    counted = errors.groupBy("run_id").agg(
        F.bool_or("fatal").alias("_fatal"), F.count(F.lit(1)).alias("_errors")
    )
    return runs.join(counted, "run_id", "left").select(
        *runs.columns,
        F.when(F.col("_fatal"), "failed")
        .when(F.col("_errors") > 0, "partial")
        .otherwise("completed")
        .alias("status"),
    )


def run_summary(
    runs: DataFrame, observed: DataFrame, scores: DataFrame, strategies: DataFrame, errors: DataFrame
) -> DataFrame:
    """One final row per run: status, the three counts and the error text (null if none).

    Every input shrinks to one row per run before the joins.
    """
    return (
        run_status(runs.select("run_id"), errors)
        .join(candidate_count(observed), "run_id", "left")
        .join(scored_count(scores), "run_id", "left")
        .join(strategy_count(strategies), "run_id", "left")
        .join(error_messages(errors), "run_id", "left")
        .fillna(0, ["candidate_count", "scored_count", "strategy_count"])
    )
