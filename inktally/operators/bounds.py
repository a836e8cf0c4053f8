"""Bounds of keys as plain comparisons of columns, which a scan can use to leave out row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose order a scan knows from its statistics.
_PLAIN = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def from_key(columns: Sequence[Column], key: Sequence[object]) -> Column:
    """Whether a row's columns are the key's or come after it, one column after the other, nulls last."""
    if not columns:
        return F.lit(True)
    first, value = columns[0], key[0]
    if value is None:
        return first.isNull() & from_key(columns[1:], key[1:])
    if len(columns) == 1:
        return (first >= F.lit(value)) | first.isNull()
    return (first > F.lit(value)) | first.isNull() | ((first == F.lit(value)) & from_key(columns[1:], key[1:]))


def up_to_key(columns: Sequence[Column], key: Sequence[object]) -> Column:
    """Whether a row's columns are the key's or come before it."""
    if not columns:
        return F.lit(True)
    first, value = columns[0], key[0]
    if value is None:
        return first.isNotNull() | up_to_key(columns[1:], key[1:])
    if len(columns) == 1:
        return first <= F.lit(value)
    return (first < F.lit(value)) | ((first == F.lit(value)) & up_to_key(columns[1:], key[1:]))


def within(rows: DataFrame, order: Sequence[Column], low: Row | None, high: Row | None, key: str = "_key") -> DataFrame:
    """``rows`` without those that plain comparisons show to be before ``low`` or after ``high``.

    ``low`` and ``high`` are values of the sort key ``key`` of the columns
    ``order``; either end may be open.  Columns are compared up to the first
    one whose order a scan does not know.
    """
    kinds = [rows.schema[key].dataType[f"v{i}"].dataType for i in range(len(order))]
    known = next((i for i, kind in enumerate(kinds) if not isinstance(kind, _PLAIN)), len(kinds))
    columns = list(order[:known])
    if low is not None and columns:
        rows = rows.where(from_key(columns, [low[f"v{i}"] for i in range(known)]))
    if high is not None and columns:
        rows = rows.where(up_to_key(columns, [high[f"v{i}"] for i in range(known)]))
    return rows
