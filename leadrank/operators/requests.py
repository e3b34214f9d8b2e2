"""Request rows for batch inference, and the configuration columns that go with them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions.fixed import DEFAULT_TOPICS, LOOKBACK_DAYS, RANKING_NAME
from leadrank.functions.records import CANDIDATE, CANDIDATE_FIELDS


@dataclass(frozen=True)
class Settings:
    """What a run is configured with. Secrets are no part of it."""

    discovery_model: str = "discovery-model"
    scoring_model: str = "scoring-model"
    strategy_model: str = "strategy-model"
    discovery_reasoning_effort: str | None = "xhigh"
    scoring_reasoning_effort: str | None = None
    strategy_reasoning_effort: str | None = None
    discovery_prompt_version: str = "v6"
    scoring_prompt_version: str = "v6"
    strategy_prompt_version: str = "v1"
    top_candidates: int = 5
    timezone: str = "Asia/Tokyo"
    strategy_web_search: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.top_candidates <= 5:
            raise ValueError("top_candidates must be 1..5")
        ZoneInfo(self.timezone)


def today_in(as_of: datetime, timezone: str) -> date:
    """Calendar day of a job clock in the configured zone."""
    return as_of.astimezone(ZoneInfo(timezone)).date()


def stage_config(settings: Settings, stage: str) -> dict[str, Column]:
    """Model, prompt version, effort and search flag of a stage; empty texts for stages without a model."""
    search = {"discovery": True, "strategy": settings.strategy_web_search}.get(stage, False)
    return {
        "model": F.lit(getattr(settings, f"{stage}_model", "")),
        "prompt_version": F.lit(getattr(settings, f"{stage}_prompt_version", "")),
        "reasoning_effort": F.lit(getattr(settings, f"{stage}_reasoning_effort", None)).cast("string"),
        "web_search": F.lit(search),
    }


def with_stage_config(requests: DataFrame, settings: Settings, stage: str) -> DataFrame:
    return requests.withColumns(stage_config(settings, stage))


def run_config(
    settings: Settings,
    scoring_only: bool = False,
    scoring_report: bool = False,
    topics: Iterable[str] | None = None,
    replay: str | None = None,
) -> Column:
    """Configuration of a run as a JSON column: all settings, the mode and the ranking rule."""
    values = {
        **asdict(settings),
        "scoring_only": scoring_only,
        "scoring_report": scoring_report,
        "topics": None if topics is None else list(topics),
        "replay": replay,
        "ranking": RANKING_NAME,
    }
    return F.lit(json.dumps(values, ensure_ascii=False, separators=(",", ":")))


def topics_table(spark: SparkSession, topics: Iterable[str] | None = None) -> DataFrame:
    """Topics with their position; the six default ones if none are given."""
    names = DEFAULT_TOPICS if topics is None else tuple(topics)
    return spark.createDataFrame(list(enumerate(names)), "topic_no long, topic string")


def discovery_requests(topics: DataFrame, today: date | Column, with_schema: bool = True) -> DataFrame:
    """One request per topic: topic, today, the day the search should prefer to start at, and the schema."""
    day = F.lit(today) if not isinstance(today, Column) else today
    fields = [
        F.col("topic"),
        day.cast("string").alias("today"),
        F.date_sub(day, LOOKBACK_DAYS).cast("string").alias("preferred_since"),
    ]
    body = F.to_json(F.struct(*fields))
    if with_schema:
        schema = json.dumps(CANDIDATE.json_schema(), ensure_ascii=False, separators=(",", ":"))
        body = F.concat(
            F.regexp_replace(body, r"\}$", ""), F.lit(',"candidate_schema":'), F.lit(schema), F.lit("}")
        )
    return topics.withColumn("request_id", F.concat(F.lit("topic-"), F.col("topic_no").cast("string"))).withColumn(
        "input", body
    )


def candidate_json(row_fields: Iterable[str] = CANDIDATE_FIELDS) -> Column:
    """Candidate columns as JSON text; null fields stay in it."""
    return F.to_json(F.struct(*row_fields), {"ignoreNullFields": "false"})


def scoring_requests(eligible: DataFrame, row_fields: Iterable[str] = CANDIDATE_FIELDS) -> DataFrame:
    """One request per eligible trigger with the whole candidate as input; scoring never searches."""
    return eligible.withColumn(
        "request_id", F.concat(F.lit("trigger-"), F.col("trigger_id").cast("string"))
    ).withColumn("input", candidate_json(row_fields))


def score_text(total: Column) -> Column:
    """A total as the strategy prompt shows it: 80.0, 62.5, 61.25."""
    return F.regexp_replace(total.cast("decimal(5,2)").cast("string"), r"0$", "")


def strategy_requests(top: DataFrame, candidate: Column | None = None) -> DataFrame:
    """One request per selected score: candidate JSON and the total on a line of its own."""
    body = F.to_json(F.col("candidate_json"), {"ignoreNullFields": "false"}) if candidate is None else candidate
    return top.withColumn(
        "request_id", F.concat(F.lit("trigger-"), F.col("trigger_id").cast("string"))
    ).withColumn("input", F.concat(body, F.lit("\nScore: "), score_text(F.col("total_score"))))
