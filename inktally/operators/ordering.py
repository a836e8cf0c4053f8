"""Ranks, running sums and previous rows over a whole order, without one-task windows.

Rows are split into ranges of their order and written out sorted.  Each row
then knows its range and its place inside; what a range needs of those before
it is a few rows per range.  Ties are split by the row's place in the scan, so
one hot key never fills a task; whoever needs a result that does not follow the
files' layout adds a tie-breaker to the order.  These functions run jobs when
called, and write to the scratch folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inktally.sources.scratch import written
from inktally.sources.small import small_frame

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row number below


def sorted_ranges(
    frame: DataFrame, order: Sequence[Column], label: str, kept: Sequence[str] | None = None
) -> DataFrame:
    """``frame`` range-split and sorted by ``order``, nulls last, with ``_range`` and ``_place``.

    It is written out; ``kept`` names the columns to write if not all.
    """
    keys = [f"_order{i}" for i in range(len(order))]
    names = list(frame.columns if kept is None else kept)
    keyed = frame.select(
        *names,
        *[column.alias(key) for column, key in zip(order, keys)],
        F.monotonically_increasing_id().alias("_scan"),
    )
    sort = [F.col(key).asc_nulls_last() for key in (*keys, "_scan")]
    placed = (
        keyed.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop(*keys, "_scan")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    with _bounded_sample(keyed, keys):
        rows = written(placed, label)
    return rows.withColumn("_range", F.shiftright("_place", _PLACE_BITS).cast("int"))


#: Bytes of sampled keys that the driver may get for the boundaries of the ranges.
SAMPLE_BYTES = 64 << 20
_SAMPLE = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def sample_size(width: float, partitions: int) -> int:
    """Keys to sample for each range, so that all of them fit; Spark takes up to three times as many."""
    return int(max(2, min(100, SAMPLE_BYTES / (3 * max(width, 1.0) * partitions))))


@contextmanager
def _bounded_sample(keyed: DataFrame, keys: Sequence[str]) -> Iterator[None]:
    """Samples fewer keys while ranges are made, if keys are long: their mean width is measured first."""
    spark = keyed.sparkSession
    wide = [k for k in keys if not isinstance(keyed.schema[k].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))]
    if not wide:
        yield
        return
    width = keyed.agg(F.avg(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0
    before = spark.conf.get(_SAMPLE)
    spark.conf.set(_SAMPLE, str(sample_size(width, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        yield
    finally:
        spark.conf.set(_SAMPLE, before)


def ranked(
    frame: DataFrame, order: Sequence[Column], label: str = "ranked", kept: Sequence[str] | None = None
) -> DataFrame:
    """``frame`` (or the ``kept`` columns of it) with ``rank``: the row's place in the order, from 0."""
    rows = sorted_ranges(frame, order, label, kept)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    # One number per written range: as many as shuffle partitions, whatever the data.
    starts, total = [], 0
    for size in sizes:
        starts.append((size["_range"], total))
        total += size["n"]
    offsets = small_frame(frame.sparkSession, starts, "_range int, _start bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        rows.join(F.broadcast(offsets), "_range")
        .withColumn("rank", F.col("_start") + inside)
        .drop("_range", "_place", "_start")
    )


def running_totals(
    frame: DataFrame, group: str, order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """``frame`` with running totals per group in the given order.

    ``sums`` names each total and gives the expression that is added up.
    """
    measures = {f"_m{i}": column for i, column in enumerate(sums.values())}
    rows = sorted_ranges(
        frame.withColumns(measures), [F.col(group), *order], "running"
    )
    names = list(measures)
    parts = rows.groupBy(group, "_range").agg(*[F.sum(m).alias(m) for m in names])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = parts.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_start_range"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_start") for m in names],
    )
    upto = Window.partitionBy(group, "_range").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = rows.withColumns({m: F.sum(m).over(upto) for m in names})
    joined = local.join(
        starts,
        F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_start_range")),
    )
    return joined.select(
        *frame.columns,
        *[
            (F.col(m) + F.col(f"{m}_start")).alias(name)
            for m, name in zip(names, sums)
        ],
    )


def carried(frame: DataFrame, order: Sequence[Column], value: str, label: str = "carried") -> DataFrame:
    """``frame`` with the last value of a column, nulls left out, at or before each row in the whole order.

    What a range needs of those before it is one value, broadcast with one row
    per written range.
    """
    rows = sorted_ranges(frame, order, label)
    upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = rows.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    local = rows.withColumn("_local", F.last(value, ignorenulls=True).over(upto))
    kept = [F.coalesce("_local", "_carried").alias(c) if c == value else F.col(c) for c in frame.columns]
    return local.join(F.broadcast(starts), "_range").select(*kept)


def without_repeats(
    frame: DataFrame, group: str, order: Sequence[Column], compared: Sequence[str]
) -> DataFrame:
    """``frame`` without the rows that equal the row before them in their group."""
    rows = sorted_ranges(frame, [F.col(group), *order], "repeats")
    signature = F.struct(*compared)
    window = Window.partitionBy(group, "_range").orderBy("_place")
    local = rows.withColumn("_before", F.lag(signature).over(window)).withColumn(
        "_first", F.row_number().over(window) == 1
    )
    # The row before the first of a range is the last of an earlier range.
    lasts = rows.groupBy(group, "_range").agg(F.max_by(signature, "_place").alias("_last"))
    earlier = lasts.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_start_range"),
        F.lag("_last").over(Window.partitionBy(group).orderBy("_range")).alias("_carried"),
    )
    joined = local.join(
        earlier,
        F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_start_range")),
    )
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    same = [F.col(name).eqNullSafe(before[name]) for name in compared]
    repeated = before.isNotNull() & reduce(lambda a, b: a & b, same)
    return joined.where(~repeated).select(*frame.columns)
