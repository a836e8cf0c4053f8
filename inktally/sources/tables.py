"""Reading source tables: files, session tables, JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.spec import TableSpec


def select_columns(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """The columns of the table's spec, in its order."""
    return frame.select(*[F.col("`" + c.name.replace("`", "``") + "`") for c in spec.columns])


def read_table(spark: SparkSession, spec: TableSpec, path: str, format: str = "parquet", **options) -> DataFrame:
    """A table kept in files."""
    return select_columns(spark.read.format(format).options(**options).load(path), spec)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def regclass(spec: TableSpec) -> str:
    """A table's quoted name with its schema."""
    return f"{_quoted(spec.schema)}.{_quoted(spec.table)}"


def jdbc_options(
    url: str,
    spec: TableSpec,
    partitions: int = 1,
    bounds: tuple[int, int] | None = None,
    fetch_rows: int = 1000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options of one table over JDBC.

    With ``bounds`` (smallest and largest value of a one-column numeric key)
    the read is split into ranges of that key.
    """
    options = {
        **(properties or {}),
        "url": url,
        "dbtable": regclass(spec),
        "fetchsize": str(fetch_rows),
    }
    if bounds is not None and partitions > 1:
        if len(spec.pk) != 1:
            raise ValueError(f"{spec.name}: ranges need a key of one column; use jdbc_predicates")
        low, high = bounds
        options |= {
            "partitionColumn": _quoted(spec.pk[0]),
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(partitions),
        }
    return options


def _text(value: str) -> str:
    """An SQL literal whose type the database takes from what it is compared with."""
    return "'" + value.replace("'", "''") + "'"


def histogram_query(spec: TableSpec) -> str:
    """Bounds of PostgreSQL's equal-depth histogram of a key's first column, in the column's order, as a table to read.

    At most 10,001 rows, the database's own limit; none for a table that it has not analysed.
    """
    where = {"schemaname": spec.schema, "tablename": spec.table, "attname": spec.pk[0]}
    named = " AND ".join(f"{column} = {_text(value)}" for column, value in where.items())
    return (
        "(SELECT bound, place FROM pg_stats, unnest(histogram_bounds::text::text[]) WITH ORDINALITY AS u(bound, place) "
        f"WHERE {named}) AS t"
    )


def key_ranges(key: str, histogram: Sequence[str], partitions: int) -> list[str]:
    """Conditions that split a table into ranges of a column with about equally many rows, nulls in the first.

    Each row meets one of them, whatever has changed since the histogram was made.  There are fewer than
    ``partitions`` where the histogram has fewer bounds.
    """
    parts = max(len(histogram) - 1, 1)
    cuts = list(dict.fromkeys(histogram[parts * i // partitions] for i in range(1, partitions) if parts * i // partitions))
    if not cuts:
        return ["TRUE"]
    name = _quoted(key)
    first = f"({name} < {_text(cuts[0])} OR {name} IS NULL)"
    inner = [f"{name} >= {_text(low)} AND {name} < {_text(high)}" for low, high in zip(cuts, cuts[1:])]
    return [first, *inner, f"{name} >= {_text(cuts[-1])}"]


def jdbc_predicates(
    spec: TableSpec, partitions: int, pages: int | None = None, histogram: Sequence[str] | None = None
) -> list[str]:
    """Conditions that split a PostgreSQL table.

    With a ``histogram`` of the key's first column each part is one of its :func:`key_ranges`.
    With the table's number of pages (``relpages`` of its catalog) each part is a
    range of pages, which the database reads alone.  Without, each part is a
    hash bucket of the key or of the whole row, and reads the table once.
    """
    if histogram:
        return key_ranges(spec.pk[0], histogram, partitions)
    if pages is not None:
        cuts = [pages * i // partitions for i in range(1, partitions)]
        lows = [""] + [f"ctid >= '({cut},0)'::tid" for cut in cuts]
        highs = [f"ctid < '({cut},0)'::tid" for cut in cuts] + [""]
        return [" AND ".join(part for part in pair if part) or "TRUE" for pair in zip(lows, highs)]
    names = spec.pk or [c.name for c in spec.columns]
    row = ", ".join(_quoted(n) for n in names)
    bucket = f"abs(hashtextextended(ROW({row})::text, 0) % {partitions})"
    return [f"{bucket} = {i}" for i in range(partitions)]


def read_jdbc(
    spark: SparkSession,
    url: str,
    spec: TableSpec,
    partitions: int = 1,
    bounds: tuple[int, int] | None = None,
    fetch_rows: int = 1000,
    properties: Mapping[str, str] | None = None,
    pages: int | None = None,
    histogram: Sequence[str] | None = None,
) -> DataFrame:
    """A database table, read in parallel by key ranges, equal-depth key ranges, page ranges or hash buckets.

    Connections do not share a snapshot: a table that changes during the read
    can repeat or miss rows.
    """
    options = jdbc_options(url, spec, partitions, bounds, fetch_rows, properties)
    if bounds is None and partitions > 1:
        rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        frame = spark.read.jdbc(
            url, options["dbtable"], predicates=jdbc_predicates(spec, partitions, pages, histogram), properties=rest
        )
    else:
        frame = spark.read.format("jdbc").options(**options).load()
    return select_columns(frame, spec)


def session_specs(
    spark: SparkSession, database: str, pks: Mapping[str, Sequence[str]] | None = None, **options
) -> list[TableSpec]:
    """Specs of the base tables of a session database; its views are left out."""
    pks = pks or {}
    found = [t.name for t in spark.catalog.listTables(database) if t.tableType not in ("VIEW", "TEMPORARY")]
    return [
        TableSpec.of(spark.table(f"{database}.{name}").schema, name, database, pks.get(name, ()), **options)
        for name in sorted(found)
    ]
