"""Places in the order of a table, found by counting key ranges instead of sorting the table.

To find the row at a place, a bounded sample of keys cuts the order into ranges,
a scan of the key columns counts their rows, and the range that holds the place
is cut again, until it is one key or a few rows.  Bounds of a range reach the
scan as plain comparisons.  Nothing is written and no task holds more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.operators.bounds import within

#: Cuts of a step, sampled keys for each, their bytes on the driver, rows that one task may put in order.
CUTS, PER_CUT, SAMPLE_BYTES, FEW = 15, 20, 16 << 20, 20_000


def sort_key(order: Sequence[Column]) -> Column:
    """The order columns as one value that sorts with nulls last."""
    return F.struct(*[c for i, o in enumerate(order) for c in (o.isNull().alias(f"n{i}"), o.alias(f"v{i}"))])


@dataclass(frozen=True)
class Place:
    """A key, and how many rows with that key come before the place."""

    key: Row
    before: int


def literal(frame: DataFrame, key: Row, name: str = "_key") -> Column:
    """A key as a value in a query over ``frame``."""
    layout = T.StructType([T.StructField("k", frame.schema[name].dataType)])
    return frame.sparkSession.createDataFrame([(key,)], layout).select("k").scalar()


def _cuts(part: DataFrame, count: int) -> list[Row]:
    """Some keys of ``part`` in order, about equally far apart: one scan, unless keys are long."""
    share, seed, length = min(1.0, CUTS * PER_CUT / count), 1, F.octet_length(F.to_json("_key"))
    short = F.when(length <= SAMPLE_BYTES // (2 * CUTS * PER_CUT), F.col("_key"))
    while True:
        some = part.sample(share, seed) if share < 1 else part
        found = some.agg(
            F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(short)).alias("keys")
        ).first()
        if found["bytes"] is None:
            share, seed = min(1.0, 4 * share), seed + 1
        elif len(found["keys"]) == found["n"]:
            keys = found["keys"]
            break
        elif found["bytes"] > SAMPLE_BYTES and share * count > 2:
            share = share * SAMPLE_BYTES / found["bytes"] / 2
        else:
            keys = [row["_key"] for row in some.orderBy("_key").collect()]
            break
    chosen = [keys[len(keys) * i // (CUTS + 1)] for i in range(1, CUTS + 1)]
    return [key for i, key in enumerate(chosen) if not i or key != chosen[i - 1]]


def _range_of(cuts: Column, low: int, high: int) -> Column:
    """How many cuts are not above the key, found by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    below = F.col("_key") < cuts[middle]
    return F.when(below, _range_of(cuts, low, middle)).otherwise(_range_of(cuts, middle + 1, high))


def place_at(rows: DataFrame, rank: int, order: Sequence[Column] = ()) -> Place | None:
    """The place of the row with that many rows before it; None beyond the end.

    ``rows`` has a column ``_key``, the sort key of its columns ``order``, by
    which a scan may leave out what a step has ruled out.  Runs jobs: two scans of
    the key columns per step, each step some ten times narrower than the last.
    """
    keys = rows.select("_key")
    part, before, count = keys, rank, keys.count()
    bounds: list[Row | None] = [None, None]
    while before < count:
        if count <= FEW:
            order = Window.orderBy("_key")
            found = part.select(
                "_key", F.row_number().over(order).alias("_nth"), F.rank().over(order).alias("_rank")
            ).where(F.col("_nth") == before + 1)
            row = found.first()
            return Place(row["_key"], before + 1 - row["_rank"])
        cuts = _cuts(part, count)
        if len(cuts) == 1:  # perhaps one key alone; else its largest is a cut that parts it
            ends = part.agg(F.min("_key").alias("low"), F.max("_key").alias("high")).first()
            if ends["low"] == ends["high"]:
                return Place(ends["low"], before)
            cuts = [ends["high"]]
        layout = T.StructType([T.StructField("cuts", T.ArrayType(keys.schema["_key"].dataType))])
        listed = keys.sparkSession.createDataFrame([(cuts,)], layout).select("cuts").scalar()
        own = _range_of(F.col("_cuts"), 0, len(cuts))
        sizes = part.withColumn("_cuts", listed).groupBy(own.alias("range")).count().orderBy("range").collect()
        for size in sizes:
            if before < size["count"]:
                break
            before -= size["count"]
        low = cuts[size["range"] - 1] if size["range"] else bounds[0]
        high = cuts[size["range"]] if size["range"] < len(cuts) else bounds[1]
        bounds = [low, high]
        part, count = between(within(rows, order, low, high), low, high).select("_key"), size["count"]
    return None


def between(rows: DataFrame, low: Row | None, high: Row | None, name: str = "_key") -> DataFrame:
    """Rows from one key on, up to but without another."""
    out = rows
    if low is not None:
        out = out.where(F.col(name) >= literal(rows, low, name))
    if high is not None:
        out = out.where(F.col(name) < literal(rows, high, name))
    return out
