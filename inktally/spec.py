"""Descriptions of tables and settings; plain Python, no Spark jobs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import types as T

#: A column is textual if its lower-cased type name contains one of these.
TEXTUAL_TYPES = (
    "text",
    "character varying",
    "varchar",
    "character",
    "char",
    "citext",
    "json",
    "jsonb",
    "uuid",
)

#: Default names of a column that holds a row's last change.
UPDATED_AT_CANDIDATES = ("updated_at", "modified_at", "updatedon")

#: Catalog type name given to a Spark type when none is declared.
_TYPE_NAMES = (
    (T.VarcharType, "character varying"),
    (T.CharType, "character"),
    (T.StringType, "text"),
    (T.ByteType, "smallint"),
    (T.ShortType, "smallint"),
    (T.IntegerType, "integer"),
    (T.LongType, "bigint"),
    (T.DecimalType, "numeric"),
    (T.FloatType, "real"),
    (T.DoubleType, "double precision"),
    (T.BooleanType, "boolean"),
    (T.DateType, "date"),
    (T.TimestampType, "timestamp with time zone"),
    (T.TimestampNTZType, "timestamp without time zone"),
    (T.BinaryType, "bytea"),
    (T.ArrayType, "ARRAY"),
    (T.StructType, "jsonb"),
    (T.MapType, "jsonb"),
    (T.VariantType, "jsonb"),
    (T.DayTimeIntervalType, "interval"),
    (T.YearMonthIntervalType, "interval"),
)


def type_name(kind: T.DataType) -> str:
    """Catalog type name of a Spark type."""
    for spark_type, name in _TYPE_NAMES:
        if isinstance(kind, spark_type):
            return name
    return "USER-DEFINED"


def is_textual(name: str) -> bool:
    """Whether a catalog type name counts as text in ``auto`` mode."""
    lowered = name.lower()
    return any(part in lowered for part in TEXTUAL_TYPES)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str
    nullable: bool = True
    default: str | None = None
    position: int = 0
    pk_position: int | None = None


@dataclass(frozen=True)
class TableSpec:
    """One table: its columns in order, its key and its last-change column."""

    schema: str
    table: str
    columns: tuple[ColumnSpec, ...]
    pk: tuple[str, ...] = ()
    updated_at: str | None = None

    @property
    def name(self) -> str:
        return f"{self.schema}.{self.table}"

    @classmethod
    def of(
        cls,
        frame_schema: T.StructType,
        table: str,
        schema: str = "public",
        pk: Sequence[str] = (),
        updated_at_candidates: Sequence[str] = UPDATED_AT_CANDIDATES,
        types: Mapping[str, str] | None = None,
    ) -> TableSpec:
        """Spec of a DataFrame's schema; ``types`` overrides type names (``json``, ``uuid`` ...)."""
        types = types or {}
        places = {name: place for place, name in enumerate(pk, 1)}
        columns = tuple(
            ColumnSpec(
                name=f.name,
                type_name=types.get(f.name, type_name(f.dataType)),
                nullable=f.nullable,
                position=place,
                pk_position=places.get(f.name),
            )
            for place, f in enumerate(frame_schema.fields, 1)
        )
        found = find_updated_at([c.name for c in columns], updated_at_candidates)
        return cls(schema, table, columns, tuple(pk), found)

    def content_columns(self, mode: str = "auto", excluded: Iterable[str] = ()) -> list[str]:
        """Names of the columns that become text lines, in column order."""
        if mode not in ("auto", "all"):
            raise ValueError(f"mode must be 'auto' or 'all', not {mode!r}")
        hidden = {name.lower() for name in excluded}
        return [
            c.name
            for c in self.columns
            if c.name.lower() not in hidden and (mode == "all" or is_textual(c.type_name))
        ]

    def with_types(self, **types: str) -> TableSpec:
        """The same table with other catalog type names for some columns."""
        columns = tuple(replace(c, type_name=types.get(c.name, c.type_name)) for c in self.columns)
        return replace(self, columns=columns)


def find_updated_at(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that names a column, without regard to case, in its real spelling.

    Of column names equal but for case the last one counts.
    """
    by_lower = {name.lower(): name for name in names}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


@dataclass(frozen=True)
class EstimateConfig:
    """Settings of an estimate.

    ``redact_fallback`` keeps excluded columns out of the text made for rows
    without any line; the default includes the whole row.  ``parallel`` tables
    are counted at a time.  A table that takes more than ``time_limit`` seconds
    once its turn has come is given up; None sets no limit.
    """

    mode: str = "auto"
    excluded: tuple[str, ...] = ()
    run_id: str = "cost-estimate"
    redact_fallback: bool = False
    parallel: int = 8
    time_limit: float | None = None
