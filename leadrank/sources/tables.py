"""The stored tables: Parquet folders under one root.

Rows of a run live in `<table>/run_id=<n>`, so filters on the run prune folders and a repeated run replaces
exactly its own rows. Companies change over time without MERGE: each run writes the companies that it saw, and a
reader takes the latest row of each. Every so many runs the state before a run is written whole, in buckets by id, so that
readers need not go further back, and need not shuffle it: later changes come to the buckets. A path is never
overwritten while it is being read.

What a run wrote of the companies counts from the moment its manifest exists, a small file that names the data files. A
folder without one was left by a run that did not end, and a reader says so instead of passing over it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadrank.operators.ids import assign_ids, max_id
from leadrank.schemas import RUN_SCOPED, TABLES


# So many runs may follow the last whole state of the companies.
COMPACT_AFTER = 32
# Companies per bucket of a whole state.
BUCKET_ROWS = 1_000_000
MANIFESTS = "_manifests"


class IncompleteRun(RuntimeError):
    """A folder of the companies that no manifest vouches for, or that lacks a file which its manifest names."""


class Store:
    """Tables under `root`, any path Hadoop file systems can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        location = hadoop.Path(path)
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def exists(self, path: str) -> bool:
        files, location = self._files(path)
        return files.exists(location)

    def _names_in(self, table: str) -> list[str]:
        files, location = self._files(self.path(table))
        if not files.exists(location):
            return []
        return [status.getPath().getName() for status in files.listStatus(location)]

    def _manifest_path(self, table: str, run: int) -> str:
        return f"{self.path(table)}/{MANIFESTS}/run_id={run}.json"

    def _commit(self, table: str, run: int, **facts) -> None:
        """Write the manifest of a folder: the files it consists of, and `facts`. It appears whole or not at all."""
        names = [name for name in self._names_in(f"{table}/run_id={run}") if name.startswith("part-")]
        files, target = self._files(self._manifest_path(table, run))
        draft = self._files(f"{self.path(table)}/{MANIFESTS}/.{uuid.uuid4().hex}")[1]
        text = json.dumps({"files": sorted(names), "written": uuid.uuid4().hex, **facts})
        stream = files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        files.delete(target, False)
        if not files.rename(draft, target):
            raise OSError(f"could not write {target}")

    def _discard(self, table: str, run: int) -> None:
        """Take back the manifest of a folder, then the folder."""
        for path in (self._manifest_path(table, run), f"{self.path(table)}/run_id={run}"):
            files, location = self._files(path)
            files.delete(location, True)

    def _manifest(self, table: str, run: int) -> dict:
        path = self._manifest_path(table, run)
        if not self.exists(path):
            raise IncompleteRun(f"run {run} did not finish writing {table}: repeat it, or call discard_run({run})")
        (row,) = self.spark.read.text(path, wholetext=True).collect()
        manifest = json.loads(row["value"])
        lost = set(manifest["files"]) - set(self._names_in(f"{table}/run_id={run}"))
        if lost:
            raise IncompleteRun(f"run {run} of {table} lacks {len(lost)} files, such as {min(lost)}")
        return manifest

    def _runs_in(self, table: str) -> list[int]:
        """Runs with a folder in a table; one folder per run, so the list stays short."""
        return [int(name.split("=")[1]) for name in self._names_in(table) if name.startswith("run_id=")]

    def incomplete_runs(self, table: str = "companies") -> list[int]:
        """Runs whose folder has no manifest."""
        return sorted(run for run in self._runs_in(table) if not self.exists(self._manifest_path(table, run)))

    def discard_run(self, run: int) -> None:
        """Drop what a run has left of the companies."""
        for table in ("companies", "companies_whole"):
            self._discard(table, run)

    def ensure_tables(self) -> None:
        """Create missing tables as empty folders; readers bring the declared schema."""
        for table in TABLES:
            files, location = self._files(self.path(table))
            files.mkdirs(location)

    def read(self, table: str, before_run: int | None = None) -> DataFrame:
        """A table with its declared columns, optionally only what runs before `before_run` wrote."""
        if table == "companies":
            return self._companies(before_run)
        ddl = TABLES[table]
        stored = self.spark.read.schema(ddl if table in RUN_SCOPED else f"{ddl}, run_id long").parquet(
            self.path(table)
        )
        if before_run is not None:
            stored = stored.where(F.col("run_id") < before_run)
        return stored.select(*T.StructType.fromDDL(ddl).names)

    def _company_runs(self, before_run: int | None) -> tuple[int | None, list[int]]:
        """The run after which the companies were last written whole, and the runs that changed some since."""
        allowed = lambda run: before_run is None or run < before_run
        done = set(self._runs_in("companies_whole")) - set(self.incomplete_runs("companies_whole"))
        whole = max(filter(allowed, done), default=None)
        return whole, sorted(run for run in self._runs_in("companies") if allowed(run) and (whole is None or run > whole))

    def _changes(self, run: int) -> DataFrame:
        names = self._manifest("companies", run)["files"]
        folder = f"{self.path('companies')}/run_id={run}"
        if not names:
            return self.spark.createDataFrame([], TABLES["companies"]).withColumn("run_id", F.lit(run))
        read = self.spark.read.schema(TABLES["companies"])
        return read.parquet(*[f"{folder}/{name}" for name in names]).withColumn("run_id", F.lit(run))

    def _whole(self, run: int) -> DataFrame:
        """A whole state as a bucketed table, so that a join by id needs no exchange of it."""
        manifest = self._manifest("companies_whole", run)
        path = f"{self.path('companies_whole')}/run_id={run}"
        name = self._table_name(path, manifest["written"])
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({TABLES['companies']}) USING parquet "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {manifest['buckets']} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    @staticmethod
    def _table_name(path: str, written: str) -> str:
        return "leadrank_companies_" + hashlib.md5(f"{path}|{written}".encode()).hexdigest()

    def _companies(self, before_run: int | None) -> DataFrame:
        """The latest row of each company. Rows that later runs changed meet the whole state in its buckets."""
        whole, later = self._company_runs(before_run)
        names = T.StructType.fromDDL(TABLES["companies"]).names
        if whole is None and not later:
            return self.spark.createDataFrame([], TABLES["companies"])
        if not later:
            return self._whole(whole).select(*names)
        rows = reduce(DataFrame.unionByName, [self._changes(run) for run in later])
        latest = rows.select(*names)
        if len(later) > 1:
            latest = rows.groupBy("id").agg(F.max_by(F.struct(*names), "run_id").alias("row")).select("row.*")
        if whole is None:
            return latest
        return self._whole(whole).select(*names).join(rows.select("id"), "id", "left_anti").unionByName(latest)

    def compact_companies(self, run_id: int, after: int = COMPACT_AFTER, bucket_rows: int = BUCKET_ROWS) -> None:
        """Before run `run_id`: write the companies whole if more than `after` runs have followed the last time."""
        whole, later = self._company_runs(run_id)
        if len(later) + (whole is not None) > after:
            last = max(later) if later else whole
            state = self._companies(run_id)
            buckets = max(1, -(-state.count() // bucket_rows))
            path, draft = f"{self.path('companies_whole')}/run_id={last}", f"leadrank_draft_{uuid.uuid4().hex}"
            self._discard("companies_whole", last)
            rows = state.repartition(buckets, "id").write.mode("overwrite").format("parquet").option("path", path)
            rows.bucketBy(buckets, "id").sortBy("id").saveAsTable(draft)
            self.spark.sql(f"DROP TABLE {draft}")  # the files stay: the table is an external one
            self._commit("companies_whole", last, buckets=buckets)

    def write_run(self, rows: DataFrame, table: str, run_id: int) -> None:
        """Write the rows of one run; a repeated run replaces them, and whole states that came after it are dropped."""
        path = f"{self.path(table)}/run_id={run_id}"
        if table != "companies":
            rows.drop("run_id").write.mode("overwrite").parquet(path)
            return
        for later in (run for run in self._runs_in("companies_whole") if run >= run_id):
            self._discard("companies_whole", later)
        files, manifest = self._files(self._manifest_path(table, run_id))
        files.delete(manifest, False)
        rows.drop("run_id").write.mode("overwrite").parquet(path)
        self._commit(table, run_id)

    def append_table(self, rows: DataFrame, table: str) -> None:
        """Append rows of any runs to a run-scoped table."""
        rows.write.mode("append").partitionBy("run_id").parquet(self.path(table))

    def next_id_after(self, table: str, before_run: int) -> int:
        if table == "companies":  # older rows of a company have its id too
            whole, later = self._company_runs(before_run)
            parts = [self._changes(run) for run in later] + ([] if whole is None else [self._whole(whole)])
            return max((max_id(part.select("id")) for part in parts), default=0)
        return max_id(self.read(table, before_run))

    def new_run_id(self) -> int:
        """An id above those of all runs begun or allotted; one job writes to a store at a time."""
        begun = [int(name.split("=")[1]) for name in self._names_in("runs") if name.startswith("run_id=")]
        allotted = 0
        if self.exists(f"{self.root}/batches"):
            batches = self.spark.read.schema("run_id long").json(f"{self.root}/batches/*")
            allotted = batches.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]
        return max([allotted, *begun]) + 1

    def run_of_batch(self, stream: str, batch: int) -> int:
        """The run id of a batch of a stream: allotted when the batch is first seen, the same one when it is repeated."""
        path = f"{self.root}/batches/{stream}-{batch}"
        if not self.exists(f"{path}/_SUCCESS"):
            self.spark.createDataFrame([(self.new_run_id(),)], "run_id long").write.mode("overwrite").json(path)
        return self.spark.read.schema("run_id long").json(path).first()["run_id"]

    def with_ids(self, rows: DataFrame, table: str, run_id: int, order: str | list[str]) -> DataFrame:
        """Rows with ids that continue those of earlier runs, in the order of `order`."""
        return assign_ids(rows, order, "id", self.next_id_after(table, run_id))

    def stage(self, rows: DataFrame, name: str, run_id: int) -> DataFrame:
        """Write an intermediate result of a run and read it back; model calls are never repeated by a plan."""
        path = f"{self.root}/work/run_id={run_id}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
