"""Table profiles from the statistics in the footers of Parquet files.

The row count, the newest of a date column and the largest whole-number key are
aggregates that Spark pushes down to the footers: no data page is read.  A key's
largest *text* is then looked for among the keys with the leading digits that it
has to have, which a sorted table holds in few row groups.  What footers cannot
answer (times, texts, keys of several columns, files without statistics) is
scanned, only those columns.

The rows are those of :func:`inktally.operators.profile.table_snapshots`; null
keys, empty tables and tables without a key included.  The jobs run when called,
one row per table comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.operators.documents import RowText
from inktally.operators.profile import max_pk, max_updated_at
from inktally.sources.small import small_frame
from inktally.spec import TableSpec

#: Most leading digits that a largest key is looked for with.
MOST_DIGITS = 6


def footer_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that reads Parquet so that aggregates are pushed down."""
    made = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            made.conf.set(name, value)
    others = [s for s in made.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip().lower() != "parquet"]
    made.conf.set("spark.sql.sources.useV1SourceList", ",".join(others))
    made.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return made


def _whole_key(frame: DataFrame, spec: TableSpec) -> str | None:
    """The key, if it is one column of whole numbers."""
    if len(spec.pk) == 1 and isinstance(frame.schema[spec.pk[0]].dataType, T.IntegralType):
        return spec.pk[0]
    return None


def _dated(frame: DataFrame, spec: TableSpec) -> bool:
    return spec.updated_at is not None and isinstance(frame.schema[spec.updated_at].dataType, T.DateType)


def from_footers(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """One row of what footers answer: ``rows``, and where they can, ``changed`` and ``largest`` (the key as a number)."""
    asked = [F.count(F.lit(1)).alias("rows")]
    if _dated(frame, spec):
        asked.append(max_updated_at(frame, spec).alias("changed"))
    if (key := _whole_key(frame, spec)) is not None:
        asked.append(F.max(RowText.cell(key)).alias("largest"))
    return frame.agg(*asked)


def with_leading_nines(key: Column, digits: int, largest: int) -> Column:
    """Whether a whole number up to ``largest`` begins with so many nines: no other text is larger than theirs."""
    nines = 10**digits - 1
    lows = [nines * 10**more for more in range(len(str(largest)) - digits + 1)]
    ranges = [key.between(F.lit(low), F.lit(min(low + low // nines - 1, largest))) for low in lows if low <= largest]
    return reduce(lambda one, other: one | other, ranges, F.lit(False))


def _largest_text(frame: DataFrame, spec: TableSpec, rows: int, largest: int | None) -> str | None:
    """The largest text of a whole-number key, whose largest number is known."""
    # Keys without gaps have some with any leading digits, one fewer than their count has.
    digits = min(MOST_DIGITS, len(str(rows)) - 1)
    if digits and largest is not None and largest > 0:
        chosen = frame.where(with_leading_nines(RowText.cell(spec.pk[0]), digits, largest))
        found = chosen.agg(max_pk(spec).alias("text")).first()["text"]
        if found is not None:
            return found
    return frame.agg(max_pk(spec).alias("text")).first()["text"]


def _snapshot(frame: DataFrame, spec: TableSpec) -> tuple:
    try:
        known = from_footers(frame, spec).first().asDict()
    except (PySparkException, Py4JJavaError):
        # Files without statistics; if it is another fault, the scan meets it as well.
        known = {}
    else:
        # Files without rows have no row of counts.
        known["rows"] = known["rows"] or 0
    if spec.updated_at is None:
        known["changed"] = None
    if not spec.pk:
        known["text"] = None
    if "largest" in known:
        known["text"] = _largest_text(frame, spec, known["rows"], known["largest"])
    scanned = {"rows": F.count(F.lit(1)), "changed": max_updated_at(frame, spec), "text": max_pk(spec)}
    missing = [made.alias(name) for name, made in scanned.items() if name not in known]
    if missing:
        known |= frame.agg(*missing).first().asDict()
    return spec.schema, spec.table, known["rows"], known["changed"], known["text"]


def snapshots_from_statistics(spark: SparkSession, tables: Sequence[tuple[str, TableSpec]]) -> DataFrame:
    """Row count, newest change and largest key of Parquet tables, given as (path, spec); footers first, scans for the rest."""
    session = footer_session(spark)
    with ThreadPoolExecutor(8) as pool:
        rows = list(pool.map(lambda table: _snapshot(session.read.parquet(table[0]), table[1]), tables))
    layout = "schema string, table string, row_count bigint, max_updated_at string, max_pk_lexicographic string"
    return small_frame(spark, rows, layout)
