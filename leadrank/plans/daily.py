"""One run over the current state: discover, check, resolve, score, rank, propose, report."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadrank.functions import records
from leadrank.functions.scoring import evaluation_priority
from leadrank.functions.text import canonical_url, redact
from leadrank.operators import report
from leadrank.operators.ids import assign_ids
from leadrank.operators.inference import batch_generate, failed_rows
from leadrank.operators.ranking import rank_scores
from leadrank.operators.requests import (
    Settings,
    discovery_requests,
    run_config,
    scoring_requests,
    stage_config,
    strategy_requests,
    today_in,
    topics_table,
    with_stage_config,
)
from leadrank.operators.resolve import company_changes, resolve_companies
from leadrank.operators.runs import run_summary
from leadrank.operators.triggers import dedup_triggers, eligible_triggers, new_triggers
from leadrank.operators.validation import (
    attempts_with_problem,
    explode_candidates,
    last_valid_attempt,
    review_candidates,
    typed_json,
)
from leadrank.schemas import TABLES
from leadrank.sources.files import read_replay, write_discovery_cache, write_report
from leadrank.sources.tables import Store

log = logging.getLogger(__name__)

# Places of errors: the stages of a run follow each other.
_STAGE_ORDER = {"discovery": 0, "scoring": 1, "strategy": 2, "pipeline": 3}
_STAGE_WIDTH = 1 << 50
_ERRORS_DDL = "ord long, stage string, subject string, error_type string"


@dataclass(frozen=True)
class RunResult:
    run_id: int
    status: str


def run_batch(
    spark: SparkSession,
    root: str,
    settings: Settings,
    call: Callable[[dict], dict] | None,
    as_of: datetime,
    *,
    topics: Iterable[str] | None = None,
    responses: DataFrame | None = None,
    scoring_only: bool = False,
    scoring_report: bool = False,
    discovery_cache: str | None = None,
    replay: str | None = None,
    run_id: int | None = None,
    secrets: Iterable[str] = (),
    **inference: object,
) -> RunResult:
    """Run once. `as_of` is the job clock with a time zone.

    Candidates come from model calls per topic, from recorded `responses` (see `read_responses`), or from a
    `replay` of saved candidates, which scores every item again. `scoring_only` and `scoring_report` stop
    after ranking. A fault of one topic, trigger or strategy becomes an error row; a fault of the run itself
    is recorded and makes the run `failed`.
    """
    if scoring_only and scoring_report:
        raise ValueError("scoring_only and scoring_report cannot be combined")
    if replay is not None and not (scoring_only or scoring_report):
        raise ValueError("a replay needs scoring_only or scoring_report")
    store = Store(spark, root)
    store.ensure_tables()
    if run_id is None:
        run_id = store.new_run_id()
    config = run_config(settings, scoring_only, scoring_report, topics, replay)
    job = _Run(store, settings, call, as_of, run_id, config, dict(inference), tuple(secrets), scoring_only)
    job.write_run_row("running")
    try:
        if call is None:
            raise ValueError("no model call configured")
        candidates, evidence = job.candidates(topics, responses, replay, discovery_cache)
        observed = job.observe(candidates, evidence)
        scores = job.score(observed, replay is not None)
        strategies = job.empty("strategies") if scoring_only or scoring_report else job.propose(scores)
        summary = job.summarize(observed, scores, strategies)
        job.report(summary, scores, strategies, scoring_only, scoring_only or scoring_report)
        return job.close(summary)
    except Exception as error:  # the run is recorded as failed, with the class of the error only
        log.debug("run %d failed", run_id, exc_info=True)
        return job.fail(error)


class _Run:
    """The steps of one run; each writes its result before the next one reads it."""

    def __init__(self, store, settings, call, as_of, run_id, config, inference, secrets, quiet) -> None:
        self.store, self.settings, self.call, self.as_of = store, settings, call, as_of
        self.run_id, self.config, self.inference, self.secrets = run_id, config, inference, secrets
        self.quiet = quiet  # no alert, as in scoring-only mode
        self.spark = store.spark
        self.errors: list[DataFrame] = []
        self.observed = self.scored = None  # what the run has got to

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table])

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        return self.store.stage(rows, name, self.run_id)

    def stage_columns(self, stage: str) -> tuple:
        config = stage_config(self.settings, stage)
        return config["model"].alias("model"), config["prompt_version"].alias("prompt_version")

    def add_errors(self, rows: DataFrame) -> None:
        self.errors.append(rows.select("ord", "stage", "subject", "error_type"))

    def generate(self, requests: DataFrame, stage: str, shape: records.Closed) -> DataFrame:
        """Call the model for each request; the answers are written once and read from there."""
        asked = with_stage_config(requests, self.settings, stage)
        return self.stage(batch_generate(asked, self.call, shape, **self.inference), f"{stage}_answers")

    def candidates(self, topics, responses, replay, cache) -> tuple[DataFrame, DataFrame]:
        """Accepted candidates in arrival order, and the sorted evidence of each request."""
        none = self.spark.createDataFrame([], "request_id string, evidence array<string>")
        if replay is not None:
            found = self.stage(read_replay(self.spark, replay), "accepted")
            return found, none
        if responses is None:
            asked = discovery_requests(
                topics_table(self.spark, topics), today_in(self.as_of, self.settings.timezone)
            )
            asked = asked.select("topic_no", "topic", "request_id", "input")
            answers = self.generate(asked, "discovery", records.DISCOVERY)
        else:
            asked = responses.select("topic_no", "topic", "request_id").distinct()
            tried = attempts_with_problem(responses, records.DISCOVERY)
            answers = self.stage(last_valid_attempt(tried), "discovery_answers")
        answers = answers.withColumn(
            "evidence",
            F.array_sort(F.array_distinct(F.transform("evidence", canonical_url))),
        ).join(asked.select("topic_no", "topic", "request_id"), "request_id")
        self.add_errors(
            answers.where(F.col("error_type").isNotNull()).select(
                F.col("topic_no").alias("ord"),
                F.lit("discovery").alias("stage"),
                F.col("topic").alias("subject"),
                "error_type",
            )
        )
        items = explode_candidates(
            answers.where(F.col("error_type").isNull()).select(
                "request_id", "topic_no", "topic", "evidence", "text"
            )
        )
        today = today_in(self.as_of, self.settings.timezone)
        reviewed = self.stage(
            review_candidates(items, today).drop("item", "evidence"), "reviewed"
        )
        self.add_errors(
            reviewed.where(F.col("reject_reason").isNotNull())
            .groupBy("topic_no", "topic")
            .agg(F.count(F.lit(1)))
            .select(
                F.col("topic_no").alias("ord"),
                F.lit("discovery").alias("stage"),
                F.col("topic").alias("subject"),
                F.lit("ValueError").alias("error_type"),
            )
        )
        # Arrival numbers are unique whatever the topic numbers are: places in the order of topic, request and item.
        places = assign_ids(
            reviewed.where(F.col("reject_reason").isNull()).select("topic_no", "request_id", "item_no"),
            ["topic_no", "request_id", "item_no"],
            "ord",
        )
        accepted = reviewed.join(places, ["topic_no", "request_id", "item_no"]).select(
            "ord", "request_id", "topic", "candidate.*"
        )
        # The job clock is authoritative; stamps written by a model are never trusted.
        accepted = accepted.withColumn("discovered_at", F.lit(self.as_of))
        if cache is not None:
            write_discovery_cache(accepted, cache)
        return accepted, answers.select("request_id", "evidence")

    def observe(self, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
        """Resolve companies and triggers, store the new ones, and give back all observations."""
        self.store.compact_companies(self.run_id)
        companies = self.store.read("companies", self.run_id)
        triggers = self.store.read("triggers", self.run_id)
        company_start = self.store.next_id_after("companies", self.run_id)
        resolved = self.stage(resolve_companies(candidates, companies, company_start), "resolved")
        self.store.write_run(company_changes(companies, resolved, self.as_of), "companies", self.run_id)
        trigger_start = self.store.next_id_after("triggers", self.run_id)
        observed = self.observed = self.stage(dedup_triggers(resolved, triggers, trigger_start), "observed")
        self.store.write_run(
            new_triggers(
                observed,
                evidence,
                self.as_of,
                self.run_id,
                self.settings.discovery_model,
                self.settings.discovery_prompt_version,
            ),
            "triggers",
            self.run_id,
        )
        return observed

    def score(self, observed: DataFrame, replay: bool) -> DataFrame:
        """Score what is eligible, rank, and store the scores with their ranks."""
        earlier = self.store.read("research_scores", self.run_id)
        eligible = self.stage(eligible_triggers(observed, earlier, replay), "eligible")
        asked = scoring_requests(eligible)
        answers = self.generate(asked, "scoring", records.EVALUATION)
        self.add_errors(
            failed_rows(answers, asked.withColumn("ord", F.col("first_ord")), "scoring", "company_name")
            .withColumn("ord", F.col("ord") + _STAGE_ORDER["scoring"] * _STAGE_WIDTH)
        )
        evaluated = (
            asked.join(answers.where(F.col("error_type").isNull()).select("request_id", "text"), "request_id")
            .withColumn("evaluation_json", typed_json(F.col("text"), records.EVALUATION_DDL))
            .select(
                "company_id",
                "trigger_id",
                F.lit(self.run_id).cast("long").alias("run_id"),
                F.struct(*records.CANDIDATE_FIELDS).alias("candidate_json"),
                "evaluation_json",
                evaluation_priority(F.col("evaluation_json")).alias("total_score"),
                *self.stage_columns("scoring"),
                F.lit(None).cast("int").alias("selected_rank"),
                F.lit(self.as_of).alias("created_at"),
                "first_ord",
            )
        )
        with_ids = self.store.with_ids(evaluated, "research_scores", self.run_id, "first_ord")
        scored = self.scored = self.stage(with_ids, "scored")
        ranked = rank_scores(scored.drop("first_ord"), self.settings.top_candidates)
        self.store.write_run(ranked, "research_scores", self.run_id)
        return self.run_rows("research_scores")

    def run_rows(self, table: str) -> DataFrame:
        return self.store.read(table).where(F.col("run_id") == self.run_id)

    def propose(self, scores: DataFrame) -> DataFrame:
        """A strategy for each selected score; a failed one leaves the rank as it is."""
        top = scores.where(F.col("selected_rank").isNotNull()).withColumn(
            "ord", F.col("selected_rank") + F.lit(_STAGE_ORDER["strategy"] * _STAGE_WIDTH)
        )
        asked = strategy_requests(top)
        answers = self.generate(asked, "strategy", records.STRATEGY)
        named = asked.withColumn("company_name", F.col("candidate_json.company_name"))
        self.add_errors(failed_rows(answers, named, "strategy", "company_name"))
        good = answers.where(F.col("error_type").isNull())
        rows = asked.drop("evidence").join(good, "request_id").select(
            "company_id",
            "trigger_id",
            typed_json(F.col("text"), records.STRATEGY_DDL).alias("content_json"),
            *self.stage_columns("strategy"),
            F.lit(self.as_of).alias("created_at"),
            F.lit(self.run_id).cast("long").alias("run_id"),
            F.array_sort("evidence").alias("evidence_urls"),
            "ord",
        )
        self.store.write_run(
            self.store.with_ids(rows, "strategies", self.run_id, "ord").drop("ord"), "strategies", self.run_id
        )
        return self.run_rows("strategies")

    def write_errors(self) -> DataFrame:
        rows = self.spark.createDataFrame([], _ERRORS_DDL)
        for part in self.errors:
            rows = rows.unionByName(part)
        rows = self.stage(rows.withColumn("fatal", F.col("stage") == "pipeline"), "errors")
        models = F.create_map(
            *[
                F.lit(value)
                for stage in ("discovery", "scoring", "strategy")
                for value in (stage, getattr(self.settings, f"{stage}_model"))
            ]
        )
        versions = F.create_map(
            *[
                F.lit(value)
                for stage in ("discovery", "scoring", "strategy")
                for value in (stage, getattr(self.settings, f"{stage}_prompt_version"))
            ]
        )
        in_order = ["ord", "stage", "subject", "error_type"]
        stored = self.store.with_ids(rows, "processing_errors", self.run_id, in_order).select(
            "id",
            F.lit(self.run_id).cast("long").alias("run_id"),
            "stage",
            redact(F.col("subject"), self.secrets).alias("subject"),
            "error_type",
            F.coalesce(models[F.col("stage")], F.lit("")).alias("model"),
            F.coalesce(versions[F.col("stage")], F.lit("")).alias("prompt_version"),
            F.lit(self.as_of).alias("created_at"),
        )
        self.store.write_run(stored, "processing_errors", self.run_id)
        self.written_errors = rows.withColumn("run_id", F.lit(self.run_id).cast("long"))
        return self.written_errors

    def summarize(self, observed, scores, strategies) -> DataFrame:
        run = F.lit(self.run_id).cast("long")
        runs = self.spark.range(1).select(run.alias("run_id"))
        return self.stage(
            run_summary(runs, observed.withColumn("run_id", run), scores, strategies, self.write_errors()),
            "summary",
        )

    def report(self, summary, scores, strategies, scoring_only: bool, skipped: bool) -> None:
        """Text of the run in pieces; an alert precedes it if there were errors, except in scoring-only mode."""
        day = F.lit(str(today_in(self.as_of, self.settings.timezone))).alias("day")
        ranked = scores.where(F.col("selected_rank").isNotNull())
        main = report.format_report(
            summary.select("*", day), report.strategies_of(ranked, strategies), skipped
        )
        pieces = report.split_messages(main, "report", ["run_id"]).withColumn("chunk_no", F.col("chunk_no").cast("long"))
        if not scoring_only:
            later = pieces.withColumn("chunk_no", F.col("chunk_no") + _STAGE_WIDTH)
            pieces = self.alert(summary).unionByName(later)
        self.write_report(pieces)

    def alert(self, summary: DataFrame) -> DataFrame:
        """The alert in pieces; it is never one value, so a run may have any number of errors."""
        return report.error_report_pieces(summary, self.written_errors)

    def write_report(self, pieces: DataFrame) -> None:
        write_report(pieces, f"{self.store.root}/reports/run_id={self.run_id}", self.secrets)

    def write_run_row(self, status: str, summary: DataFrame | None = None) -> None:
        base = self.spark.range(1).select(F.lit(self.run_id).cast("long").alias("id")) if summary is None else (
            summary.withColumn("id", F.col("run_id"))
        )
        known = lambda name, kind, other: (
            F.lit(other).cast(kind) if summary is None else F.col(name).cast(kind)
        ).alias(name)
        finished = None if status == "running" else self.as_of
        self.store.write_run(
            base.select(
                "id",
                F.lit(self.as_of).alias("started_at"),
                (F.lit(finished).cast("timestamp") if finished is None else F.current_timestamp()).alias(
                    "finished_at"
                ),
                F.lit(status).alias("status"),
                known("candidate_count", "int", 0),
                known("scored_count", "int", 0),
                known("strategy_count", "int", 0),
                known("error_message", "string", None),
                self.config.alias("config_json"),
            ),
            "runs",
            self.run_id,
        )

    def close(self, summary: DataFrame) -> RunResult:
        status = summary.first()["status"]
        self.write_run_row(status, summary)
        return RunResult(self.run_id, status)

    def fail(self, error: Exception) -> RunResult:
        row = [(_STAGE_ORDER["pipeline"] * _STAGE_WIDTH, "pipeline", "run", type(error).__name__)]
        self.add_errors(self.spark.createDataFrame(row, _ERRORS_DDL))
        run = F.lit(self.run_id).cast("long")
        none = self.spark.createDataFrame([], "company_id long")
        reached = [none if rows is None else rows for rows in (self.observed, self.scored)]
        summary = self.stage(
            run_summary(
                self.spark.range(1).select(run.alias("run_id")),
                *[rows.select("company_id", run.alias("run_id")) for rows in (*reached, none)],
                self.write_errors(),
            ),
            "summary",
        )
        if not self.quiet:
            self.write_report(self.alert(summary))
        self.write_run_row("failed", summary)
        return RunResult(self.run_id, "failed")
