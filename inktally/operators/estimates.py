"""Sums over documents: per table, in all, with errors kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inktally.sources.small import small_frame

_TABLE = ["schema", "table"]

RESULTS = (
    "schema string, table string, row_count bigint, token_count bigint, status string, "
    "error_message string, completed_at timestamp_ntz"
)


def table_estimates(counted: DataFrame) -> DataFrame:
    """Rows and tokens per table of documents with ``token_count``."""
    return counted.groupBy(*_TABLE).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("token_count"),
    )


def listed_estimates(sums: DataFrame, tables: DataFrame) -> DataFrame:
    """Row and token sums of each of ``tables`` (``schema``, ``table``); zeros without a document."""
    return tables.select(*_TABLE).distinct().join(sums, _TABLE, "left").select(
        *_TABLE,
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("token_count", F.lit(0)).cast("bigint").alias("token_count"),
    )


def totals(estimates: DataFrame) -> DataFrame:
    """Tokens and rows over all tables that succeeded; zeros if there are none."""
    good = estimates
    if "status" in estimates.columns:
        good = estimates.where(F.col("status") == "completed")
    return good.agg(
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows"),
    )


def total_tokens(estimates: DataFrame) -> DataFrame:
    return totals(estimates).select("total_tokens")


def total_rows(estimates: DataFrame) -> DataFrame:
    return totals(estimates).select("total_rows")


def table_report(estimates: DataFrame) -> DataFrame:
    """A line per table, by name, and a last line ``TOTAL``."""
    # A row of zeros without a table gives the total of no tables its line.
    layout = "schema string, table string, row_count bigint, token_count bigint"
    none = small_frame(estimates.sparkSession, [(None, None, 0, 0)], layout)
    counted = estimates.select(none.columns).unionByName(none)
    lines = counted.groupingSets([["schema", "table"], []], "schema", "table").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("token_count").alias("token_count"),
        F.grouping("schema").alias("is_total"),
    )
    name = F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.concat_ws(".", *_TABLE))
    return lines.where((F.col("is_total") == 1) | F.col("table").isNotNull()).select(
        name.alias("name"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("token_count", F.lit(0)).cast("bigint").alias("token_count"),
        F.col("is_total").cast("int").alias("is_total"),
    ).orderBy("is_total", "name")
