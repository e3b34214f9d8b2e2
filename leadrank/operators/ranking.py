"""Ranking of scored triggers and its evaluation against human ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.functions.fixed import STAGES
from leadrank.functions.scoring import evaluation_means


def best_trigger_per_company(scores: DataFrame) -> DataFrame:
    """Strongest trigger of each company in each run; equal totals go to the lower trigger id.

    Spark limits each group inside the map tasks first, so a company with very many triggers sends one row
    per task through the shuffle.
    """
    order = Window.partitionBy("run_id", "company_id").orderBy(F.desc("total_score"), F.asc("trigger_id"))
    return scores.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def select_top(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best companies of each run with `selected_rank` 1..k; equal totals go to the lower company id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy("run_id").orderBy(F.desc("total_score"), F.asc("company_id"))
    return (
        best_trigger_per_company(scores)
        .withColumn("selected_rank", F.row_number().over(order))
        .where(F.col("selected_rank") <= k)
    )


def rank_scores(scores: DataFrame, k: int = 5) -> DataFrame:
    """All score rows with their `selected_rank`, null for those not selected.

    The selected rows, k per run, come from a plan that prunes in the map tasks; the join on the unique score
    id spreads evenly.
    """
    top = select_top(scores.select("id", "run_id", "company_id", "trigger_id", "total_score"), k)
    return scores.drop("selected_rank").join(top.select("id", "selected_rank"), "id", "left")


def ratings_of(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """Score rows with the human rating of their company in their run, null where there is none."""
    votes = ratings.select("run_id", "company_id", F.col("id").alias("rating_id"), "rating")
    return scores.join(votes, ["run_id", "company_id"], "left")


def precision_at_k(
    scores: DataFrame, ratings: DataFrame, k: int = 5, by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Share of good ratings among ranks 1..k, only where exactly k rows are ranked and all are rated."""
    ranked = scores.where(F.col("selected_rank").between(1, k))
    return (
        ratings_of(ranked, ratings)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_ranked"),
            F.count("rating_id").alias("_rated"),
            F.count_if(F.col("rating") == "good").alias("_good"),
        )
        .where((F.col("_ranked") == k) & (F.col("_rated") == k))
        .select(*by, (F.col("_good").cast("double") / F.col("_ranked")).alias(f"precision_at_{k}"))
    )


def compare_models(
    scores: DataFrame,
    ratings: DataFrame,
    k: int = 5,
    by: Sequence[str] = ("model", "prompt_version"),
) -> DataFrame:
    """Per model and prompt version: scores, mean total, ranked rows, rated ones, share of good ones.

    `by` may name any column of the scores, for example one taken from a run's configuration. Only ranked rows meet the
    ratings; all scores are summed where they are read, and both kinds of rows meet in one aggregation.
    """
    ranked = scores.where(F.col("selected_rank").between(1, k))
    votes = ratings_of(ranked, ratings).select(
        *by, F.lit(True).alias("_vote"), F.lit(None).cast("double").alias("total_score"), "rating_id", "rating"
    )
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in votes.dtypes[-2:]]
    totals = scores.select(*by, F.lit(False).alias("_vote"), F.col("total_score").cast("double"), *nothing)
    rated, good = F.count("rating_id"), F.count_if(F.col("rating") == "good")
    return (
        totals.unionByName(votes)
        .groupBy(*by)
        .agg(
            F.count_if(~F.col("_vote")).alias("scored"),
            F.avg("total_score").alias("mean_total"),
            F.count_if("_vote").alias("ranked"),
            rated.alias("rated"),
            F.when(rated > 0, good.cast("double") / rated).alias("good_share"),
        )
    )


def stage_summary(ranked: DataFrame, evaluation: str = "evaluation_json") -> DataFrame:
    """Stage means with the coverage of their evidence, for ranked score rows."""
    value = F.col(evaluation)
    means = evaluation_means(value)
    columns: list[Column] = []
    for stage in STAGES:
        columns.append(means[stage].alias(f"{stage}_mean"))
        columns.append(value["evidence_coverage"][stage]["coverage"].alias(f"{stage}_coverage"))
    return ranked.select("run_id", "company_id", "trigger_id", "selected_rank", *columns)
