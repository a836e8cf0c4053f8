"""Progress that follows a growing log of table results.

Sums per run are state of the stream. A batch writes the documents of the runs whose sums it changed, with their
costs, and the lines that came in; what did not change is not written again. A small file names the batches that
readers have to read. When there are many, the newest document of each run is written to one folder in their place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inktally.operators.estimates import RESULTS
from inktally.operators.progress import (
    progress_costs,
    progress_document,
    remove_folder,
    replace_file,
    run_sums,
    snapshot_of,
    table_lines,
)
from inktally.sources.scratch import exists, folders

LOG = f"run_id bigint, {RESULTS}"
DOCUMENT = (
    "runId bigint, startTime string, lastUpdate string, status string, progress struct<completed:bigint,"
    "total:bigint,errors:bigint,percentComplete:bigint>, totals struct<totalTokens:bigint,totalRows:bigint>, "
    "elapsedSeconds bigint, batch bigint"
)
LINE = (
    "runId bigint, schema string, table string, rowCount bigint, tokenCount bigint, status string, "
    "errorMessage string, completedAt string"
)
COST = "runId bigint, model string, cost double, batch bigint"


@dataclass(frozen=True)
class Following:
    """The two streams of a progress: documents and costs of runs, and lines of tables."""

    snapshots: StreamingQuery
    lines: StreamingQuery

    def awaitTermination(self, timeout: int | None = None) -> bool:
        return all([self.snapshots.awaitTermination(timeout), self.lines.awaitTermination(timeout)])

    def stop(self) -> None:
        self.snapshots.stop()
        self.lines.stop()


def _live(spark: SparkSession, out_path: str) -> list[str]:
    """Batches that readers read, oldest first; none before the first."""
    if not exists(spark, f"{out_path}/CURRENT"):
        return []
    return [r["value"] for r in spark.read.text(f"{out_path}/CURRENT").collect()]


def _read(spark: SparkSession, out_path: str, live: Sequence[str], part: str, layout: str) -> DataFrame:
    paths = [f"{out_path}/batches/{b}/{part}" for b in live]
    return spark.read.schema(layout).json(paths) if paths else spark.createDataFrame([], layout)


def current_snapshots(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest document of each run."""
    return _newest(_read(spark, out_path, _live(spark, out_path), "snapshots", DOCUMENT)).drop("batch")


def _newest(documents: DataFrame) -> DataFrame:
    names = documents.columns
    return documents.groupBy("runId").agg(F.max_by(F.struct(*names), "batch").alias("d")).select("d.*")


def current_costs(spark: SparkSession, out_path: str) -> DataFrame:
    """The costs by model that belong to the newest document of each run."""
    live = _live(spark, out_path)
    return _newest_costs(
        _read(spark, out_path, live, "costs", COST), _read(spark, out_path, live, "snapshots", DOCUMENT)
    ).drop("batch")


def _newest_costs(costs: DataFrame, documents: DataFrame) -> DataFrame:
    return costs.join(documents.groupBy("runId").agg(F.max("batch").alias("batch")), ["runId", "batch"], "left_semi")


def current_lines(spark: SparkSession, out_path: str) -> DataFrame:
    """The lines of all tables that have ended."""
    return spark.read.schema(LINE).json(f"{out_path}/tables")


def write_batch(
    snapshots: DataFrame, prices: DataFrame, out_path: str, batch: int, run_ids: Sequence[int] | None = None, most: int = 20
) -> None:
    """Writes the documents and costs of some runs as a batch and lets readers see it.

    A batch that is repeated takes its own place.  With ``most`` batches to read,
    the newest of each run are written to one folder; what it replaces stays
    until the next time, for readers that are still on it.
    """
    spark, live = snapshots.sparkSession, _live(snapshots.sparkSession, out_path)
    name = f"{batch + 1:020d}"  # the first, before any result, is 0
    costs = progress_costs(snapshots, prices, run_ids).select(F.col("run_id").alias("runId"), "model", "cost")
    for part, rows in (("snapshots", progress_document(snapshots)), ("costs", costs)):
        rows.withColumn("batch", F.lit(batch + 1)).write.mode("overwrite").json(f"{out_path}/batches/{name}/{part}")
    live = [b for b in live if b != name] + [name]
    if len(live) > most:
        whole = f"{name}-whole"
        of_runs = _read(spark, out_path, live, "snapshots", DOCUMENT)
        _newest(of_runs).write.mode("overwrite").json(f"{out_path}/batches/{whole}/snapshots")
        _newest_costs(_read(spark, out_path, live, "costs", COST), of_runs).write.mode("overwrite").json(f"{out_path}/batches/{whole}/costs")
        for old in set(folders(spark, f"{out_path}/batches")) - {*live, whole}:
            remove_folder(spark, f"{out_path}/batches/{old}")
        live = [whole]
    replace_file(spark, f"{out_path}/CURRENT", live)


def follow_progress(
    spark: SparkSession,
    log_path: str,
    runs: DataFrame,
    prices: DataFrame,
    out_path: str,
    checkpoint: str,
    run_ids: Sequence[int] | None = None,
    layout: str = LOG,
    available_now: bool = False,
    interval: str = "1 second",
    files_per_batch: int | None = None,
    most: int = 20,
) -> Following:
    """Publishes all runs under ``out_path`` at the first start, and then what changes as files arrive at ``log_path``.

    The state is one row of sums per run, in the state store; it survives a
    restart with the same ``checkpoint``.  Costs are those of all runs, or of
    ``run_ids``.  The log's folder has to exist.
    """
    options = {} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
    log = spark.readStream.schema(layout).options(**options).parquet(log_path)
    if not _live(spark, out_path):
        none = run_sums(spark.createDataFrame([], T.StructType.fromDDL(layout)))
        write_batch(snapshot_of(none, runs), prices, out_path, -1, run_ids, most)

    def follow(sums: DataFrame, batch: int) -> None:
        changed = sums.persist()  # the rows of one batch, read for documents and for costs
        try:
            touched = runs.join(changed.select("run_id"), "run_id", "left_semi")
            write_batch(snapshot_of(changed, touched), prices, out_path, batch, run_ids, most)
        finally:
            changed.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    sums = run_sums(log).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/runs")
    lines = table_lines(log).writeStream.format("json").option("path", f"{out_path}/tables")
    return Following(
        sums.foreachBatch(follow).trigger(**trigger).start(),
        lines.option("checkpointLocation", f"{checkpoint}/lines").trigger(**trigger).start(),
    )
