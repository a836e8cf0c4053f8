"""Table profiles: row count, newest change, largest key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions.values import cell, iso_millis
from inktally.operators.documents import RowText, union_all
from inktally.spec import TableSpec


def max_updated_at(frame: DataFrame, spec: TableSpec) -> Column:
    """Newest value of the last-change column as ISO text; null without such a column.

    Of a text column, the largest text is read as a date; null if it is none.
    """
    if spec.updated_at is None:
        return F.lit(None).cast("string")
    value, kind = cell(spec.updated_at), frame.schema[spec.updated_at].dataType
    if isinstance(kind, T.StringType):
        return iso_millis(f"try_cast(max({value}) as timestamp)", T.TimestampType(), frame.sparkSession)
    return iso_millis(f"max({value})", kind, frame.sparkSession)


def max_pk(spec: TableSpec) -> Column:
    """Largest key as text, parts joined by ``|``; text order, so 9 comes after 10."""
    if not spec.pk:
        return F.lit(None).cast("string")
    parts = [F.coalesce(RowText.cell(n).cast("string"), F.lit("")) for n in spec.pk]
    return F.max(F.concat_ws("|", *parts))


def table_snapshot(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """Row count, newest change and largest key of a table, in one scan of those columns."""
    return frame.agg(
        F.count(F.lit(1)).alias("row_count"),
        max_updated_at(frame, spec).alias("max_updated_at"),
        max_pk(spec).alias("max_pk_lexicographic"),
    ).select(
        F.lit(spec.schema).alias("schema"),
        F.lit(spec.table).alias("table"),
        "row_count",
        "max_updated_at",
        "max_pk_lexicographic",
    )


def table_row_count(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """Row count alone; column files answer it from their footers."""
    return frame.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"), "row_count"
    )


def table_snapshots(tables: Iterable[tuple[DataFrame, TableSpec]]) -> DataFrame:
    """The snapshots of several tables, as one job."""
    return union_all([table_snapshot(frame, spec) for frame, spec in tables])


def row_counts(tables: Iterable[tuple[DataFrame, TableSpec]]) -> DataFrame:
    """The row counts of several tables, as one job."""
    return union_all([table_row_count(frame, spec) for frame, spec in tables])


def large_tables(snapshots: DataFrame, threshold: int = 50_000) -> DataFrame:
    """Tables with at least ``threshold`` rows."""
    return snapshots.where(F.col("row_count") >= threshold)
