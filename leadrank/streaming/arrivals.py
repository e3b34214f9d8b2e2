"""The daily run over whatever responses have arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadrank.operators.requests import Settings
from leadrank.plans.daily import run_batch
from leadrank.session import cut_lineage
from leadrank.sources.files import responses_of
from leadrank.sources.tables import Store


def run_available(
    spark: SparkSession,
    arrivals: str,
    root: str,
    settings: Settings,
    call: Callable[[dict], dict],
    clock: Callable[[], datetime],
    files_per_run: int | None = None,
    **options: object,
) -> None:
    """One run per batch of newly arrived response files, then stop.

    Files hold JSON lines as `read_responses` takes them. Each batch is one run with an id of its own, above those of all
    runs in the store; the store keeps which one. A batch that is repeated after a lost driver gets the same id again,
    replaces its own rows and starts from the state before it, so nothing is counted twice. A stream whose checkpoint is
    lost counts as a new one: it makes new runs and touches no old one.
    """
    reader = spark.readStream
    if files_per_run is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    store = Store(spark, root)
    store.ensure_tables()

    def run(batch: DataFrame, batch_id: int) -> None:
        (stream,) = spark.read.text(f"{store.root}/arrivals/metadata").select(F.get_json_object("value", "$.id")).first()
        run_batch(
            spark,
            store.root,
            settings,
            call,
            clock(),
            responses=cut_lineage(responses_of(batch)),
            run_id=store.run_of_batch(stream, batch_id),
            **options,
        )

    (
        reader.text(arrivals)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{store.root}/arrivals")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
