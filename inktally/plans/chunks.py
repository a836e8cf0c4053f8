"""Chunks of a large table, counted range by range, so that a run can stop and go on.

A manifest of key ranges is written once: the first key of each range, and how many rows come before it. Ranges are
whole numbers of chunks. The plan of chunks, slices and the counting of chunks all read it; none sorts the table again.
Each range is a job that reads the rows between two keys and appends its chunks to a log; a later run of
the same id counts only the ranges whose chunks the log lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from inktally.operators.bounds import within
from inktally.operators.documents import RowText
from inktally.operators.ordering import ranked
from inktally.operators.places import literal, sort_key
from inktally.operators.slices import chunk_plan, content_tie, merge_chunks, order_columns
from inktally.operators.tokens import Tokenizer
from inktally.sources.scratch import exists, written
from inktally.sources.small import small_frame
from inktally.spec import EstimateConfig, TableSpec

CHUNKS = (
    "run_id bigint, schema string, table string, chunk_id string, chunk_index bigint, row_count bigint, "
    "token_count bigint, completed_at timestamp_ntz"
)


def _keyed(frame: DataFrame, spec: TableSpec) -> tuple[DataFrame, list[Column]]:
    """The rows with their sort key, and what orders rows with equal keys."""
    order = order_columns(frame, spec)
    return frame.withColumns({"_key": sort_key(order), "_tie": content_tie(frame, spec)}), order


def _place(rows: DataFrame, start: Row) -> Column:
    return F.struct(literal(rows, start["_key"]).alias("_key"), F.lit(start["_tie"]).alias("_tie"))


@dataclass(frozen=True)
class KeyRanges:
    """A table's order in ranges: their first keys, and what comes before them.

    ``starts`` has a row per range, ``most_ranges`` at most, with ``first_rank``
    (rows before it), ``_key`` and ``_tie`` of its first row, and ``copies``,
    how many rows equal to that one come before it.
    """

    spec: TableSpec
    starts: tuple[Row, ...]
    row_count: int
    chunk_rows: int
    chunks_in_range: int
    manifest: DataFrame

    @classmethod
    def write(cls, frame: DataFrame, spec: TableSpec, path: str, chunk_rows: int = 10_000, most_ranges: int = 64) -> KeyRanges:
        """Sorts the keys once and writes the manifest under ``path``."""
        if chunk_rows <= 0 or most_ranges <= 0:
            raise ValueError("chunk_rows and most_ranges must be positive")
        rows, _ = _keyed(frame, spec)
        keys = ranked(rows.select("_key", "_tie"), [F.col("_key"), F.col("_tie")], f"keys-{spec.table}")
        total = keys.count()
        chunks = -(-total // chunk_rows)
        each = max(1, -(-chunks // most_ranges))
        starts = keys.where(F.col("rank") % (each * chunk_rows) == 0)
        # At most ``most_ranges`` rows are looked up among the keys.
        equal = keys.join(F.broadcast(starts.select("_key", "_tie").distinct()), ["_key", "_tie"], "left_semi")
        first = equal.groupBy("_key", "_tie").agg(F.min("rank").alias("_first"))
        numbers = [F.lit(n).cast("bigint").alias(k) for k, n in (("row_count", total), ("chunk_rows", chunk_rows), ("chunks_in_range", each))]
        starts.join(F.broadcast(first), ["_key", "_tie"]).select(
            (F.col("rank") / F.lit(each * chunk_rows)).cast("int").alias("range"),
            F.col("rank").alias("first_rank"),
            (F.col("rank") - F.col("_first")).alias("copies"),
            "_key",
            "_tie",
            *numbers,
        ).coalesce(1).write.parquet(path)
        return cls.read(frame.sparkSession, spec, path, chunk_rows)

    @classmethod
    def read(cls, spark: SparkSession, spec: TableSpec, path: str, chunk_rows: int = 10_000) -> KeyRanges:
        manifest = spark.read.parquet(path)
        starts = tuple(manifest.orderBy("range").collect())
        if not starts:
            return cls(spec, starts, 0, chunk_rows, 1, manifest)
        one = starts[0]
        return cls(spec, starts, one["row_count"], one["chunk_rows"], one["chunks_in_range"], manifest)

    def plan(self) -> DataFrame:
        """The chunks of the table as :func:`chunk_plan` lists them, each with its ``range``."""
        layout = "schema string, table string, row_count bigint"
        counted = small_frame(self.manifest.sparkSession, [(self.spec.schema, self.spec.table, self.row_count)], layout)
        chunks = chunk_plan(counted, 0, self.chunk_rows)
        return chunks.withColumn("range", F.floor(F.col("chunk_index") / F.lit(self.chunks_in_range)).cast("int"))

    def ranks(self, first: int, last: int) -> tuple[int, int]:
        """Ranks of the first row of a range and of the one after another range."""
        end = self.starts[last + 1]["first_rank"] if last + 1 < len(self.starts) else self.row_count
        return self.starts[first]["first_rank"], end

    def between(self, frame: DataFrame, first: int, last: int) -> tuple[DataFrame, int]:
        """Rows from one range to another, with rows equal to their ends, and the rank of the first of these rows.

        Plain comparisons of the key columns reach the scan.
        """
        rows, order = _keyed(frame, self.spec)
        low = self.starts[first]
        high = self.starts[last + 1] if last + 1 < len(self.starts) else None
        rows = within(rows, order, low["_key"], high and high["_key"])
        place = F.struct("_key", "_tie")
        rows = rows.where(place >= _place(rows, low))
        if high is not None:
            rows = rows.where(place <= _place(rows, high))
        return rows, low["first_rank"] - low["copies"]

    def slice(self, frame: DataFrame, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in key order, equal keys by a hash of their content.

        Only the rows of the ranges that hold them are sorted.
        """
        start, end = max(offset, 0), min(max(offset, 0) + limit, self.row_count)
        if start >= end:
            return frame.where(F.lit(False))
        holding = [i for i in range(len(self.starts)) if self.ranks(i, i)[0] < end and self.ranks(i, i)[1] > start]
        rows, base = self.between(frame, holding[0], holding[-1])
        found = ranked(rows, [F.col("_key"), F.col("_tie")], f"slice-{self.spec.table}").withColumn("rank", F.col("rank") + F.lit(base))
        return found.where((F.col("rank") >= start) & (F.col("rank") < end)).orderBy("rank").select(*frame.columns)

    def chunks(self, frame: DataFrame, tokens: Column, which: int) -> DataFrame:
        """Rows and tokens of each chunk of a range; ``tokens`` is computed for the rows between its ends only."""
        rows, base = self.between(frame, which, which)
        start, end = self.ranks(which, which)
        narrow = written(rows.select("_key", "_tie", tokens.cast("bigint").alias("_tokens")), f"tokens-{self.spec.table}")
        found = ranked(narrow, [F.col("_key"), F.col("_tie")], f"range-{self.spec.table}", ["_tokens"])
        found = found.withColumn("rank", F.col("rank") + F.lit(base)).where((F.col("rank") >= start) & (F.col("rank") < end))
        index = F.floor(F.col("rank") / F.lit(self.chunk_rows)).cast("bigint")
        sums = found.groupBy(index.alias("chunk_index")).agg(F.count(F.lit(1)).alias("row_count"), F.sum("_tokens").alias("token_count"))
        return sums.select(
            F.lit(self.spec.schema).alias("schema"),
            F.lit(self.spec.table).alias("table"),
            F.concat(F.lit(f"{self.spec.name}#"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "chunk_index",
            "row_count",
            "token_count",
        )


@dataclass(frozen=True)
class ChunkLog:
    """Finished chunks of all runs, a growing table under ``path``; each append is a folder of its own, so they may meet."""

    path: str

    def read(self, spark: SparkSession, run_id: int) -> DataFrame:
        if not exists(spark, self.path):
            return spark.createDataFrame([], CHUNKS)
        return spark.read.schema(CHUNKS).option("recursiveFileLookup", True).parquet(self.path).where(F.col("run_id") == run_id)

    def append(self, chunks: DataFrame, run_id: int) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        at = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
        rows = chunks.select(F.lit(run_id).cast("bigint").alias("run_id"), *chunks.columns, at.alias("completed_at"))
        rows.coalesce(1).write.parquet(f"{self.path}/{run_id}-{uuid4().hex}")


def pending_ranges(ranges: KeyRanges, done: DataFrame) -> list[int]:
    """The ranges with chunks that the log lacks: an anti-join of the plan with it."""
    left = ranges.plan().join(done.select("chunk_id"), "chunk_id", "left_anti")
    return sorted(row["range"] for row in left.select("range").distinct().collect())


def count_chunks(
    frame: DataFrame,
    ranges: KeyRanges,
    tokens: Column,
    log: ChunkLog,
    run_id: int,
    most: int | None = None,
    ended: Callable[[int], None] | None = None,
) -> list[int]:
    """Counts the pending ranges, each a job over the cluster, ``most`` of them if given, and appends each to the log as it ends.

    ``frame`` has the columns of the table and whatever ``tokens`` reads.
    Returns the ranges that were counted.  A range that another run has logged
    in the meantime adds only the chunks that are missing.
    """
    spark = frame.sparkSession
    pending = pending_ranges(ranges, log.read(spark, run_id))[:most]

    for which in pending:
        done = log.read(spark, run_id).select("chunk_id")
        log.append(ranges.chunks(frame, tokens, which).join(done, "chunk_id", "left_anti"), run_id)
        if ended is not None:
            ended(which)
    return pending


@dataclass(frozen=True)
class Chunking:
    """Large tables of an estimate are counted by chunks, whose log lies under ``path``.

    A run that is started again with the same ``run_id`` goes on where it
    stopped.  Tables of fewer than ``threshold`` rows are counted whole.
    """

    path: str
    run_id: int
    threshold: int = 50_000
    chunk_rows: int = 10_000
    most_ranges: int = 64

    @property
    def log(self) -> ChunkLog:
        return ChunkLog(f"{self.path}/chunks")

    def ranges(self, frame: DataFrame, spec: TableSpec, row_count: int) -> KeyRanges:
        """The table's ranges as they were written, or written now; the table must not have changed in between."""
        path = f"{self.path}/ranges/{self.run_id}/{spec.name}"
        if not exists(frame.sparkSession, f"{path}/_SUCCESS"):
            return KeyRanges.write(frame, spec, path, self.chunk_rows, self.most_ranges)
        found = KeyRanges.read(frame.sparkSession, spec, path, self.chunk_rows)
        if found.row_count != row_count:
            raise ValueError(f"{spec.name} had {found.row_count} rows when run {self.run_id} began and has {row_count}; begin a new run")
        return found

    def estimate(
        self, frame: DataFrame, spec: TableSpec, row_count: int, tokenizer: Tokenizer, config: EstimateConfig | None = None
    ) -> tuple[int, int]:
        """Rows and tokens of a large table from its chunks, of which the missing ones are counted now."""
        if not row_count:
            return 0, 0
        spark, ranges = frame.sparkSession, self.ranges(frame, spec, row_count)
        counted = tokenizer.with_count(RowText(frame, spec, config).texts)
        count_chunks(counted, ranges, F.col("token_count"), self.log, self.run_id)
        (found,) = merge_chunks(self._own(spark, spec), ranges.plan()).collect()
        return found["row_count"], found["token_count"]

    def _own(self, spark: SparkSession, spec: TableSpec) -> DataFrame:
        of = (F.col("schema") == spec.schema) & (F.col("table") == spec.table)
        return self.log.read(spark, self.run_id).where(of)
