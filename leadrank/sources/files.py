"""Readers and writers for files that cross the system boundary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadrank.functions.records import CANDIDATE_FIELDS
from leadrank.functions.text import redact
from leadrank.operators.validation import validate_candidates
from leadrank.schemas import TABLES


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw model responses from JSON lines with topic_no, topic, request_id, attempt and response.

    `response` may be a JSON object or a text holding one; both arrive as text and are parsed later, so a
    malformed response is a row with a fault instead of a failed read.
    """
    return responses_of(spark.read.text(path))


def responses_of(lines: DataFrame) -> DataFrame:
    """Responses from lines of text, `value`, one row for every line that is not blank.

    A line that is no JSON, or that names no request, becomes a request of its own, named after file, line and the place
    where the line was read, without a response: it fails like any other unusable response, under the file's name as topic.
    Equal lines of a file have places of their own, which stay the same when a lost task reads its split again.
    """
    parsed = F.try_parse_json(F.col("value"))
    field = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    place = F.monotonically_increasing_id().cast("string")
    unread = F.concat(F.lit("unreadable-"), F.sha2(F.concat_ws("|", F.input_file_name(), "value", place), 256))
    return lines.where(F.trim("value") != "").select(
        F.coalesce(field("topic_no", "long"), F.lit(0)).alias("topic_no"),
        F.coalesce(field("topic", "string"), file).alias("topic"),
        F.coalesce(field("request_id", "string"), unread).alias("request_id"),
        F.coalesce(field("attempt", "int"), F.lit(0)).alias("attempt"),
        field("response", "string").alias("response"),
    )


def write_discovery_cache(candidates: DataFrame, path: str) -> None:
    """Accepted candidates as JSON lines, sharded; replaces what the path held. Nulls are written out."""
    candidates.select("ord", *CANDIDATE_FIELDS).withColumn(
        "discovered_at", F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ).withColumn("published_at", F.col("published_at").cast("string")).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def read_replay(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """Saved candidates, validated again; one bad item fails the read. No source or date gate applies.

    Reads the JSON lines of `write_discovery_cache` in their order, or with `whole_array` one JSON array per
    file. Text, not inferred JSON: inference would hide wrong types.
    """
    if whole_array:
        # What is no array becomes one malformed item, so that the read fails instead of finding nothing.
        array = F.coalesce(F.from_json("value", "array<string>"), F.array(F.lit("")))
        items = spark.read.text(path, wholetext=True).select(F.posexplode(array).alias("ord", "item"))
        items = items.withColumn("ord", F.col("ord").cast("long"))
    else:
        # The arrival number stands first in a line and is no part of the item.
        items = spark.read.text(path).select(
            F.get_json_object("value", "$.ord").cast("long").alias("ord"),
            F.regexp_replace("value", r'^\{"ord":\d+,', "{").alias("item"),
        )
    checked = validate_candidates(items)
    fault = F.concat(F.lit("replay item rejected: "), F.col("reject_reason"))
    return (
        checked.withColumn(
            "candidate",
            F.when(F.col("reject_reason").isNull(), F.col("candidate")).otherwise(F.raise_error(fault)),
        )
        .select("ord", F.lit("replay").alias("request_id"), F.lit("replay").alias("topic"), "candidate.*")
    )


def read_ratings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Human ratings with the declared schema, from Parquet or CSV with a header."""
    reader = spark.read.schema(TABLES["human_ratings"])
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def write_report(chunks: DataFrame, path: str, secrets: Iterable[str] = ()) -> None:
    """Report pieces as text, one folder per run. `chunks`: run_id, chunk_no, chunk.

    Pieces are dealt out by range, so a long report is several files, whose names follow its order; a short one is one.
    """
    safe = chunks.withColumn("chunk", redact(F.col("chunk"), secrets))
    (
        safe.repartitionByRange("run_id", "chunk_no")
        .sortWithinPartitions("run_id", "chunk_no")
        .select("run_id", "chunk")
        .write.mode("overwrite")
        .partitionBy("run_id")
        .text(path)
    )
