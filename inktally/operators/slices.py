"""Ordered slices and chunks of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions.values import cell, in_utc, json_sql
from inktally.operators.bounds import within
from inktally.operators.documents import RowText, union_all
from inktally.operators.ordering import ranked
from inktally.operators.places import literal, place_at, sort_key
from inktally.sources.scratch import written
from inktally.spec import TableSpec


def order_columns(frame: DataFrame, spec: TableSpec) -> list[Column]:
    """The key columns, or all columns of a table without a key, nulls last.

    Maps and variants have no order of their own; their canonical JSON stands in.
    """
    out = []
    for name in spec.pk or [c.name for c in spec.columns]:
        kind, value = frame.schema[name].dataType, RowText.cell(name)
        if isinstance(kind, (T.MapType, T.VariantType)):
            value = F.expr(json_sql(cell(name), kind, in_utc(frame.sparkSession)))
        out.append(value)
    return out


def content_tie(frame: DataFrame, spec: TableSpec) -> Column:
    """Orders rows with equal keys by what is in the table's columns, so that file layout plays no part."""
    utc, kinds = in_utc(frame.sparkSession), {c.name: frame.schema[c.name].dataType for c in spec.columns}
    parts = [
        F.expr(json_sql(cell(n), kind, utc)) if isinstance(kind, (T.MapType, T.VariantType)) else RowText.cell(n)
        for n, kind in kinds.items()
    ]
    return F.xxhash64(*parts)


def ordered_slice(frame: DataFrame, spec: TableSpec, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order; a limit of 0 or less gives none."""
    return bounded_scan(frame, spec, offset, max(limit, 0))


def bounded_scan(
    frame: DataFrame, spec: TableSpec, offset: int = 0, row_limit: int | None = None
) -> DataFrame:
    """Rows from ``offset`` on, at most ``row_limit`` of them, or all if that is None, in key order.

    Rows with equal keys are ordered by their hash.  Both ends of the slice are
    found by counting key ranges, which runs jobs; the slice itself is a filter
    over all key columns that reaches the scan, and a sort of what it leaves.
    The table must not change between the scans.
    """
    if row_limit is not None and row_limit <= 0:
        return frame.where(F.lit(False))
    order = order_columns(frame, spec)
    row = RowText(frame, spec)
    rows = row.full.withColumns({"_key": sort_key(order), "_tie": sort_key([row.row_hash])})
    end = None if row_limit is None else _exact(rows, order, max(offset, 0) + row_limit)
    before = rows if end is None else within(rows, order[:1], None, end[0])
    start = _exact(before, order, offset) if offset > 0 else None
    if offset > 0 and start is None:
        return frame.where(F.lit(False))
    kept = within(rows, order, start and start[0], end and end[0])
    parts = []
    if start is not None and end is not None and start[:2] == end[:2]:
        parts.append(_copies(kept, start, end[2] - start[2]))
    else:
        if start is not None and start[2]:
            parts.append(_copies(kept, start, _same(kept, start).count() - start[2]))
            kept = kept.where(_after(kept, start, strict=True))
        elif start is not None:
            kept = kept.where(_after(kept, start, strict=False))
        if end is not None:
            if end[2]:
                parts.append(_copies(kept, end, end[2]))
            kept = kept.where(~_after(kept, end, strict=False))
        parts.append(kept)
    whole = union_all([part.select(*frame.columns, "_key", "_tie") for part in parts])
    ties = ["_tie"] if any(place is not None and place[1] is not None for place in (start, end)) else []
    return whole.orderBy("_key", *ties).select(*frame.columns)


#: A place in the table: the key, the tie among equal keys (None: before the first), copies of that row before it.
_Exact = tuple[Row, "Row | None", int]


def _exact(rows: DataFrame, order: list[Column], rank: int) -> _Exact | None:
    """The place of a rank: by the first order column, then by all among the rows that share its value."""
    part, before = rows, rank
    if len(order) > 1:
        first = place_at(rows.withColumn("_key", sort_key(order[:1])), rank, order[:1])
        if first is None:
            return None
        part = _with_key(rows.withColumn("_first", sort_key(order[:1])), order[:1], first.key, "_first")
        before = first.before
    place = place_at(part, before, order)
    if place is None or place.before == 0:
        return None if place is None else (place.key, None, 0)
    ties = _with_key(part, order, place.key).select(F.col("_tie").alias("_key"))
    tie = place_at(ties, place.before)
    return place.key, tie.key, tie.before


def _with_key(rows: DataFrame, order: list[Column], key: Row, name: str = "_key") -> DataFrame:
    return within(rows, order, key, key, name).where(F.col(name) == literal(rows, key, name))


def _same(rows: DataFrame, place: _Exact) -> DataFrame:
    own = rows.where(F.col("_key") == literal(rows, place[0]))
    return own.where(F.col("_tie") == literal(rows, place[1], "_tie"))


def _copies(rows: DataFrame, place: _Exact, count: int) -> DataFrame:
    """Some of the equal rows at a place: one of them, repeated."""
    one = _same(rows, place).limit(1)
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(count)))) if count > 0 else one.limit(0)


def _after(rows: DataFrame, place: _Exact, strict: bool) -> Column:
    """Whether a row stands at a place or after it; ``strict``: after all rows equal to the one there."""
    key = literal(rows, place[0])
    if place[1] is None:
        return F.col("_key") >= key
    tie = literal(rows, place[1], "_tie")
    later = F.col("_tie") > tie if strict else F.col("_tie") >= tie
    return F.when(F.col("_key") == key, later).otherwise(F.col("_key") > key)


def chunk_plan(snapshots: DataFrame, threshold: int = 50_000, chunk_rows: int = 10_000) -> DataFrame:
    """The pieces of work of each table: chunks of a large one, else the whole table.

    A whole table has no chunk id, no index and no row limit.
    """
    split = (F.col("row_count") >= threshold) & F.lit(chunk_rows > 0)
    count = F.ceil(F.col("row_count") / F.lit(max(chunk_rows, 1)))
    n_chunks = F.when(split, count).otherwise(F.lit(1)).cast("bigint")
    name = F.concat_ws(".", "schema", "table")
    index = F.col("_index")
    return (
        snapshots.select("schema", "table", "row_count", split.alias("_split"), n_chunks.alias("n_chunks"))
        .where(F.col("n_chunks") > 0)
        .withColumn("_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
        .select(
            "schema",
            "table",
            F.when(F.col("_split"), F.concat(name, F.lit("#"), index.cast("string"))).alias("chunk_id"),
            F.when(F.col("_split"), index).alias("chunk_index"),
            F.when(F.col("_split"), index * F.lit(chunk_rows)).otherwise(F.lit(0)).cast("bigint").alias("offset_start"),
            F.when(F.col("_split"), F.lit(chunk_rows)).cast("bigint").alias("row_limit"),
            "n_chunks",
        )
    )


def chunk_estimates(
    frame: DataFrame, spec: TableSpec, tokens: Column, chunk_rows: int = 10_000, costly: bool = True
) -> DataFrame:
    """Rows and tokens of each chunk of a table, chunks being slices in key order.

    ``tokens`` is the token count of a row.  If ``costly``, it is computed once
    and written with the order columns: sampling the ranges of the sort would
    compute it again, and the texts themselves need not be sorted.
    """
    if chunk_rows <= 0:
        raise ValueError("chunk_rows must be positive")
    order = [*order_columns(frame, spec), content_tie(frame, spec)]
    keys = [f"_key{i}" for i in range(len(order))]
    narrow = frame.select(
        *[column.alias(key) for column, key in zip(order, keys)], tokens.cast("bigint").alias("_tokens")
    )
    if costly:
        narrow = written(narrow, f"tokens-{spec.table}")
    rows = ranked(narrow, [F.col(k) for k in keys], f"chunks-{spec.table}", ["_tokens"])
    index = F.floor(F.col("rank") / F.lit(chunk_rows)).cast("bigint")
    return (
        rows.groupBy(index.alias("chunk_index"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("_tokens").alias("token_count"))
        .select(
            F.lit(spec.schema).alias("schema"),
            F.lit(spec.table).alias("table"),
            F.concat(F.lit(f"{spec.name}#"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "chunk_index",
            "row_count",
            "token_count",
        )
    )


def merge_chunks(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Row and token sums of the tables whose chunks have all arrived.

    ``plan`` has ``schema``, ``table``, ``n_chunks``.  A chunk that arrived
    twice counts once: as it arrived last, if ``chunks`` has ``completed_at``,
    else with the larger counts.
    """
    table = ["schema", "table"]
    totals = plan.select(*table, "n_chunks").distinct()
    arrived = ["completed_at"] if "completed_at" in chunks.columns else []
    once = chunks.groupBy(*table, "chunk_id").agg(F.max(F.struct(*arrived, "row_count", "token_count")).alias("c"))
    return (
        once.groupBy(*table)
        .agg(
            F.sum("c.row_count").alias("row_count"),
            F.sum("c.token_count").alias("token_count"),
            F.count(F.lit(1)).alias("_arrived"),
        )
        .join(totals, table)
        .where(F.col("_arrived") == F.col("n_chunks"))
        .select(*table, "row_count", "token_count")
    )


def chunk_progress(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks done and chunks in all of each table that is split."""
    table = ["schema", "table"]
    totals = plan.where(F.col("chunk_id").isNotNull()).select(*table, "n_chunks").distinct()
    done = (
        chunks.select(*table, "chunk_id").distinct().groupBy(*table).agg(F.count(F.lit(1)).alias("_done"))
    )
    completed = F.coalesce("_done", F.lit(0)).cast("bigint")
    return totals.join(done, table, "left").select(
        *table,
        completed.alias("completed_chunks"),
        F.col("n_chunks").alias("total_chunks"),
        F.concat(completed.cast("string"), F.lit("/"), F.col("n_chunks").cast("string")).alias("label"),
    )
