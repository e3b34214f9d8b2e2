"""How the operators bind to the tables at hand: derived inputs shared by several queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadrank.functions.fixed import COVERAGE_LEVELS, STAGES
from leadrank.functions.scoring import priority, stage_mean

# One prime per rating, in stage order, so that ratings vary independently of each other.
PRIMES = (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)
TODAY = date(2024, 6, 30)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Rows that a task gets where the work is heavy per row.
TASK_ROWS = 25_000


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: dealt out to all cores, and to more tasks as it grows.

    The splits of a file follow its bytes, and a split of a narrow table holds millions of rows. A table with enough splits
    is read as it is, without a shuffle.
    """
    rows = table(spark, folder, name)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("long")


def rating(index: int) -> Column:
    share = F.floor(F.col("event_id") / F.lit(float(PRIMES[index]))).cast("long")
    return ((share + F.col("user_id")) % 11).cast("int")


def evaluation_of_event() -> Column:
    """An evaluation struct per event: fifteen ratings, a coverage per stage, short texts."""
    stages, index = [], 0
    for stage, names in STAGES.items():
        stages.append(F.struct(*[rating(index + i).alias(name) for i, name in enumerate(names)]).alias(stage))
        index += len(names)
    levels = F.array(*[F.lit(level) for level in COVERAGE_LEVELS])
    coverage = F.struct(
        *[
            F.struct(
                F.element_at(levels, ((F.col("event_id") + i) % 3 + 1).cast("int")).alias("coverage"),
                F.concat(F.lit("seen in "), F.col("event_type")).alias("reason"),
            ).alias(stage)
            for i, stage in enumerate(STAGES)
        ]
    )
    return F.struct(
        *stages,
        F.concat(F.lit("scope "), F.col("event_id").cast("string")).alias("scope_hypothesis"),
        coverage.alias("evidence_coverage"),
        F.lit("reason").alias("reason"),
        F.array().cast("array<string>").alias("strongest_signals"),
        F.array(F.concat(F.lit("risk of "), F.col("event_type"))).alias("risks"),
        F.array().cast("array<string>").alias("research_needed"),
    )


def event_means() -> list[Column]:
    """Stage means of an event, straight from its ratings."""
    return [stage_mean([rating(number * 5 + i) for i in range(5)]) for number in range(len(STAGES))]


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events as score rows: the day is the run, the user the company, the event the trigger."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        day_number(F.col("ts")).alias("run_id"),
        F.col("user_id").alias("company_id"),
        F.col("event_id").alias("trigger_id"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("prompt_version"),
        priority(*event_means()).alias("total_score"),
        F.lit(None).cast("int").alias("selected_rank"),
    )


def event_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """A human rating per user and day, missing for some."""
    pairs = (
        table(spark, folder, "events")
        .select(
            day_number(F.col("ts")).alias("run_id"),
            F.col("user_id").alias("company_id"),
            F.dayofmonth("ts").alias("day"),
        )
        .distinct()
    )
    vote = F.col("company_id") * 31 + F.col("day") * 17
    return (
        pairs.withColumn("id", vote)
        .where(F.col("id") % 8 != 0)
        .select(
            "id",
            "run_id",
            "company_id",
            F.when(F.col("id") % 7 <= 2, "good").when(F.col("id") % 7 <= 4, "maybe").otherwise("bad").alias(
                "rating"
            ),
        )
    )


def _sql_rating(index: int) -> str:
    return f"(CAST(floor(event_id / {PRIMES[index]}.0::DOUBLE) AS BIGINT) + user_id) % 11"


def _sql_mean(stage_no: int) -> str:
    return "CAST(" + " + ".join(_sql_rating(stage_no * 5 + i) for i in range(5)) + " AS DOUBLE) / 5"


SQL_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"

# Common table expressions of the oracle, matching the functions above.
SQL_SCORES = f"""
means AS (
  SELECT event_id AS id, {SQL_DAY} AS run_id, user_id AS company_id, event_id AS trigger_id,
         event_type AS model, 'v' || CAST(user_id % 3 AS VARCHAR) AS prompt_version,
         {_sql_mean(0)} AS need, {_sql_mean(1)} AS win, {_sql_mean(2)} AS deliver
  FROM events),
scores AS (
  SELECT *, round(10 * pow(need * win * deliver, CAST(1 AS DOUBLE) / 3), 2) AS total_score FROM means)"""

SQL_RANKED = f"""{SQL_SCORES},
best AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY run_id, company_id ORDER BY total_score DESC, trigger_id) = 1),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY total_score DESC, company_id) AS INTEGER)
              AS selected_rank
  FROM best QUALIFY selected_rank <= 5)"""

SQL_RATINGS = f"""
votes AS (
  SELECT DISTINCT {SQL_DAY} AS run_id, user_id AS company_id, user_id * 31 + day(ts) * 17 AS vote FROM events),
ratings AS (
  SELECT run_id, company_id, vote AS id,
         CASE WHEN vote % 7 <= 2 THEN 'good' WHEN vote % 7 <= 4 THEN 'maybe' ELSE 'bad' END AS rating
  FROM votes WHERE vote % 8 <> 0)"""
