"""Table discovery as joins over the catalog relations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inktally.sources.information_schema import InformationSchema
from inktally.spec import TEXTUAL_TYPES, UPDATED_AT_CANDIDATES, ColumnSpec, TableSpec

_TABLE = ["schema", "table"]


def list_tables(tables: DataFrame, schema: str) -> DataFrame:
    """Base tables of one schema, by name."""
    return (
        tables.where((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE"))
        .select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"))
        .orderBy("table")
    )


def select_tables(tables: DataFrame, allow: Sequence[str], block: Sequence[str] = ()) -> DataFrame:
    """Tables on the allow list (``*`` allows all) and not on the block list, in any case.

    The block list wins, and ``*`` means nothing in it.  An empty allow list
    selects nothing.
    """
    name = F.lower("table")
    kept = tables
    if "*" not in allow:
        kept = kept.where(name.isin([a.lower() for a in allow]) if allow else F.lit(False))
    if block:
        kept = kept.where(~name.isin([b.lower() for b in block]))
    return kept


def table_columns(columns: DataFrame) -> DataFrame:
    """Columns with their type, nullability, default and position."""
    return columns.select(
        F.col("table_schema").alias("schema"),
        F.col("table_name").alias("table"),
        "column_name",
        "data_type",
        (F.col("is_nullable") == "YES").alias("is_nullable"),
        "column_default",
        F.col("ordinal_position").cast("int").alias("ordinal_position"),
    )


def primary_keys(table_constraints: DataFrame, key_column_usage: DataFrame) -> DataFrame:
    """Key columns of each table with their position in the key."""
    shared = ["constraint_name", "table_schema", "table_name"]
    return (
        table_constraints.where(F.col("constraint_type") == "PRIMARY KEY")
        .join(key_column_usage, shared)
        .select(
            F.col("table_schema").alias("schema"),
            F.col("table_name").alias("table"),
            "column_name",
            F.col("ordinal_position").cast("int").alias("pk_position"),
        )
    )


def annotate_pk(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Each column with its position in the key, null if it is not part of it."""
    by = [*_TABLE, "column_name"]
    # A column listed twice keeps its last place, and must not double its row.
    places = keys.groupBy(*by).agg(F.max("pk_position").alias("pk_position"))
    return columns.join(places, by, "left")


def resolve_updated_at(columns: DataFrame, candidates: Sequence[str] = UPDATED_AT_CANDIDATES) -> DataFrame:
    """The last-change column of each table that has one.

    The first candidate found counts; of column names equal but for case, the
    last in column order.
    """
    place = F.array_position(F.array(*[F.lit(c.lower()) for c in candidates]), F.lower("column_name"))
    return (
        columns.withColumn("_place", place)
        .where(F.col("_place") > 0)
        .groupBy(*_TABLE)
        .agg(
            F.max_by(
                "column_name", F.struct(-F.col("_place"), F.col("ordinal_position"))
            ).alias("updated_at_column")
        )
    )


def table_catalog(
    relations: InformationSchema,
    schema: str,
    allow: Sequence[str] = ("*",),
    block: Sequence[str] = (),
    candidates: Sequence[str] = UPDATED_AT_CANDIDATES,
) -> DataFrame:
    """The chosen tables' columns with key position and last-change column, one row per column.

    A table without columns has one row without a column.  One scan of each
    relation, whatever the number of tables.
    """
    chosen = select_tables(list_tables(relations.tables, schema), allow, block)
    in_schema = F.col("table_schema") == schema
    columns = table_columns(relations.columns.where(in_schema)).join(chosen, _TABLE, "left_semi")
    keys = primary_keys(
        relations.table_constraints.where(in_schema), relations.key_column_usage.where(in_schema)
    )
    updated = resolve_updated_at(columns, candidates)
    described = annotate_pk(columns, keys).join(updated, _TABLE, "left")
    return chosen.join(described, _TABLE, "left")


def is_textual(data_type: Column) -> Column:
    """Whether a catalog type name counts as text in ``auto`` mode."""
    return F.lower(data_type).rlike("|".join(TEXTUAL_TYPES))


def content_columns(columns: DataFrame, mode: str = "auto", excluded: Iterable[str] = ()) -> DataFrame:
    """Columns that become text lines, with their position."""
    hidden = [name.lower() for name in excluded]
    kept = columns.where(~F.lower("column_name").isin(hidden)) if hidden else columns
    if mode == "auto":
        kept = kept.where(is_textual(F.col("data_type")))
    elif mode != "all":
        raise ValueError(f"mode must be 'auto' or 'all', not {mode!r}")
    return kept


def table_specs(catalog: DataFrame) -> Iterator[TableSpec]:
    """The descriptors of :func:`table_catalog`, one table at a time.

    Rows arrive in order, a partition at a time, so the driver never holds the
    whole catalog.
    """
    rows = catalog.orderBy(*_TABLE, "ordinal_position").toLocalIterator()
    for (schema, table), group in groupby(rows, key=lambda r: (r["schema"], r["table"])):
        described = list(group)
        columns = tuple(
            ColumnSpec(
                r["column_name"],
                r["data_type"],
                r["is_nullable"],
                r["column_default"],
                r["ordinal_position"],
                r["pk_position"],
            )
            for r in described
            if r["column_name"] is not None
        )
        keys = sorted((c for c in columns if c.pk_position is not None), key=lambda c: c.pk_position)
        yield TableSpec(
            schema, table, columns, tuple(c.name for c in keys), described[0]["updated_at_column"]
        )
