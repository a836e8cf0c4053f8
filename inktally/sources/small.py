"""Small tables made on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def small_frame(spark: SparkSession, rows: Sequence[tuple], layout: str) -> DataFrame:
    """Rows as a local relation, which the planner sees whole; ``layout`` is ``name type, ...``."""
    fields = [part.split() for part in layout.split(", ")]
    columns = [
        pa.array([row[place] for row in rows], _KINDS[kind]) for place, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))
