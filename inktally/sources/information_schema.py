"""The four catalog relations a database describes itself with."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inktally.spec import TableSpec

TABLES = "table_schema string, table_name string, table_type string"
COLUMNS = (
    "table_schema string, table_name string, column_name string, data_type string, "
    "is_nullable string, column_default string, ordinal_position int"
)
CONSTRAINTS = "table_schema string, table_name string, constraint_name string, constraint_type string"
KEY_USAGE = (
    "table_schema string, table_name string, constraint_name string, column_name string, "
    "ordinal_position int"
)


@dataclass(frozen=True)
class InformationSchema:
    tables: DataFrame
    columns: DataFrame
    table_constraints: DataFrame
    key_column_usage: DataFrame


def over_jdbc(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> InformationSchema:
    """The relations of a database; filters on them are pushed to it."""

    def relation(name: str, layout: str) -> DataFrame:
        names = [part.split()[0] for part in layout.split(", ")]
        frame = spark.read.jdbc(url, f"information_schema.{name}", properties=dict(properties or {}))
        return frame.select(*names)

    return InformationSchema(
        relation("tables", TABLES),
        relation("columns", COLUMNS),
        relation("table_constraints", CONSTRAINTS),
        relation("key_column_usage", KEY_USAGE),
    )


def of_specs(spark: SparkSession, specs: Iterable[TableSpec]) -> InformationSchema:
    """The relations of tables that are kept in files."""
    specs = list(specs)
    keyed = [s for s in specs if s.pk]
    return InformationSchema(
        spark.createDataFrame([(s.schema, s.table, "BASE TABLE") for s in specs], TABLES),
        spark.createDataFrame(
            [
                (s.schema, s.table, c.name, c.type_name, "YES" if c.nullable else "NO", c.default, c.position)
                for s in specs
                for c in s.columns
            ],
            COLUMNS,
        ),
        spark.createDataFrame(
            [(s.schema, s.table, f"{s.table}_pkey", "PRIMARY KEY") for s in keyed], CONSTRAINTS
        ),
        spark.createDataFrame(
            [
                (s.schema, s.table, f"{s.table}_pkey", name, place)
                for s in keyed
                for place, name in enumerate(s.pk, 1)
            ],
            KEY_USAGE,
        ),
    )
