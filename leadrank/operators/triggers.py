"""De-duplication of triggers, the events a company is approached for, within a run and across runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from leadrank.functions.text import (
    discovered_ts,
    drop_default_port,
    canonical_url,
    published_ts,
    sorted_evidence,
    trigger_fingerprint,
)
from leadrank.operators.ids import BLOCK_WIDTH, assign_ids
from leadrank.operators.matching import ARTICLE, FINGERPRINT, first_come_matching
from leadrank.operators.skew import HOT_ROWS, salted_lookup
from leadrank.session import cut_lineage

_EDGE = ["company_id", "trigger_type", "fingerprint", "article"]


def mark_triggers(resolved: DataFrame) -> DataFrame:
    """Adds the two marks an observation is recognised by: `fingerprint` and `article`."""
    return resolved.withColumn(
        "fingerprint",
        trigger_fingerprint(F.col("trigger_type"), F.col("trigger_title"), F.col("published_at")),
    ).withColumn("article", canonical_url(drop_default_port(F.col("source_url"))))


def _stored_marks(triggers: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of the stored triggers of `companies`; the rest of the history is filtered out first."""
    stored = triggers.select(
        "id", "company_id", "trigger_type", "fingerprint", F.col("source_url").alias("article")
    ).join(companies, "company_id", "left_semi")
    by_fingerprint = stored.groupBy(*FINGERPRINT).agg(F.min("id").alias("fingerprint_id"))
    by_article = stored.groupBy(*ARTICLE).agg(F.min("id").alias("article_id"))
    return by_fingerprint, by_article


def dedup_triggers(
    resolved: DataFrame,
    triggers: DataFrame,
    next_id_after: int = 0,
    width: int = BLOCK_WIDTH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds fingerprint, article, trigger_id and is_new to every resolved candidate.

    A candidate repeats a trigger of its company with the same fingerprint, stored earlier or kept in this
    run, or else one with the same article and type. Repeats do not extend what later candidates match.

    Copies of one observation collapse, before the shuffle, to one edge (company, type, fingerprint,
    article); all lookups of history and of this run's triggers happen on edges. Candidates meet them in one
    last lookup, where an edge with more than `hot_rows` copies is salted.
    """
    marked = mark_triggers(resolved)
    edges = cut_lineage(marked.groupBy(*_EDGE).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("key_rows")))
    by_fingerprint, by_article = _stored_marks(triggers, edges.select("company_id").distinct())
    known = cut_lineage(
        edges.join(by_fingerprint, FINGERPRINT, "left").join(by_article, ARTICLE, "left")
    )
    free = known.where(F.col("fingerprint_id").isNull() & F.col("article_id").isNull())
    kept = assign_ids(first_come_matching(free.select(*_EDGE, "ord"), width), "ord", "new_id", next_id_after)
    decided = (
        known.drop("ord")
        .join(
            kept.select(
                *FINGERPRINT, F.col("ord").alias("same_print_ord"), F.col("new_id").alias("same_print_id")
            ),
            FINGERPRINT,
            "left",
        )
        .join(
            kept.select(
                *ARTICLE, F.col("ord").alias("same_article_ord"), F.col("new_id").alias("same_article_id")
            ),
            ARTICLE,
            "left",
        )
    )
    decided = cut_lineage(decided)
    extra = [name for name in decided.columns if name not in (*_EDGE, "key_rows")]
    return (
        salted_lookup(marked, decided, _EDGE, "ord", hot_rows)
        .withColumn(
            "trigger_id",
            F.coalesce(
                F.col("fingerprint_id"),
                F.when(F.col("same_print_ord") <= F.col("ord"), F.col("same_print_id")),
                F.col("article_id"),
                F.when(F.col("same_article_ord") <= F.col("ord"), F.col("same_article_id")),
            ),
        )
        .withColumn(
            "is_new",
            F.coalesce(
                F.col("fingerprint_id").isNull() & (F.col("same_print_ord") == F.col("ord")), F.lit(False)
            ),
        )
        .drop(*extra)
    )


def new_triggers(
    observed: DataFrame, evidence: DataFrame, as_of: datetime, run_id: int, model: str, prompt_version: str
) -> DataFrame:
    """Rows for the trigger table. `evidence` has one sorted URL array per request_id; a request without
    evidence, as in a replay, stores an empty one."""
    no_urls = F.array().cast("array<string>")
    return (
        observed.where("is_new")
        .join(evidence.select("request_id", F.col("evidence").alias("_urls")), "request_id", "left")
        .select(
            F.col("trigger_id").alias("id"),
            "company_id",
            "trigger_type",
            F.col("trigger_title").alias("title"),
            F.col("trigger_summary").alias("summary"),
            F.col("article").alias("source_url"),
            "source_title",
            published_ts(F.col("published_at")).alias("published_at"),
            discovered_ts(F.col("discovered_at"), F.lit(as_of)).alias("discovered_at"),
            F.lit(run_id).cast("long").alias("run_id"),
            "fingerprint",
            "possible_video_need",
            F.lit(model).alias("model"),
            F.lit(prompt_version).alias("prompt_version"),
            sorted_evidence(F.coalesce("_urls", no_urls)).alias("evidence_urls"),
        )
    )


def _last_places(observed: DataFrame) -> DataFrame:
    return observed.groupBy("trigger_id").agg(F.max("ord").alias("ord"), F.min("ord").alias("first_ord"))


def latest_observation_per_trigger(observed: DataFrame) -> DataFrame:
    """Per trigger its last observation, with `first_ord`, the place of its first one.

    Only arrival numbers are aggregated; the payload follows by the unique arrival number.
    """
    return observed.drop("trigger_id").join(_last_places(observed), "ord")


def unscored(observed: DataFrame, scores: DataFrame) -> DataFrame:
    """Observations of triggers that no earlier run has scored."""
    return observed.join(scores.select("trigger_id").distinct(), "trigger_id", "left_anti")


def eligible_triggers(observed: DataFrame, scores: DataFrame, replay: bool = False) -> DataFrame:
    """What a run scores: each unscored trigger once, with its last payload. A replay scores all.

    Observations of a trigger collapse to their places before they meet the scores, so a trigger seen very
    often is one row there.
    """
    if replay:
        return latest_observation_per_trigger(observed)
    return observed.drop("trigger_id").join(unscored(_last_places(observed), scores), "ord")
