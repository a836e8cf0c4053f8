"""What changed between two loads of tables, told by the hashes of their documents.

A load is kept as a table of a row per document: where it is, how many rows it stands for, and their hash or the sum of
their hashes, bucketed by its identity. The next load is folded the same way and merged with it, all rows of both sides in
one join; only the new side is shuffled. Rows of a table without a key have no identity but their content, so they are counted.
Hashes are kept as bytes, each once; only what has changed gets their text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.sources.scratch import exists, folders

_TABLE = ["schema", "table"]
#: Bytes of a hash.
_HASH = 32
_PARTITIONS, _CLEANUP = "spark.sql.shuffle.partitions", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folded(documents: DataFrame) -> DataFrame:
    """(slot, schema, table, row_hash, copies, mark) of documents with their hashes.

    ``slot`` is what tells documents apart: the bytes of their ``doc_id``, and in tables without a key of that and
    their ``row_hash``, which then is null.  ``mark`` adds up the hashes of the rows that share a key, in whatever
    order they come; of one row it is null, as ``row_hash`` tells all.
    """
    slot = F.when(F.col("has_pk"), F.unhex("doc_id")).otherwise(F.concat(F.unhex("doc_id"), F.unhex("row_hash")))
    # Two 64-bit parts of the hash; sums of 38 digits cannot pass.
    halves = [F.conv(F.substring("row_hash", at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    own = {"row_hash": F.unhex("row_hash")} | {f"h{i}": h for i, h in enumerate(halves)}
    rows = documents.select(slot.alias("slot"), *_TABLE, *[F.when(F.col("has_pk"), c).alias(name) for name, c in own.items()])
    found = rows.groupBy("slot").agg(
        *[F.first(c).alias(c) for c in _TABLE],
        F.min("row_hash").alias("row_hash"),
        F.count(F.lit(1)).alias("copies"),
        *[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(halves))],
    )
    mark = F.when((F.col("copies") > 1) & F.col("row_hash").isNotNull(), F.concat_ws(":", *[F.col(f"h{i}").cast("string") for i in range(len(halves))]))
    return found.select("slot", *_TABLE, "row_hash", "copies", mark.alias("mark"))


@contextmanager
def _dealt(spark: SparkSession, parts: int) -> Iterator[None]:
    """Queries meanwhile shuffle to so many partitions, and what they shuffled goes at their end, not when the driver collects its garbage."""
    before = {name: spark.conf.get(name) for name in (_PARTITIONS, _CLEANUP)}
    try:
        spark.conf.set(_PARTITIONS, str(parts))
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class LoadedVersion:
    """A load under ``path``, bucketed by slot; the bucket number is part of the folder's name.

    ``buckets`` are the least: where there are more shuffle partitions when the load is made, it is kept in as many parts.
    In a session of no more, Spark leaves it where it is; in one of as many, the next load is shuffled once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        names = folders(spark, path) if exists(spark, path) else []
        if any(f.startswith("buckets-") for f in names):
            raise ValueError(f"{path} holds a load of an earlier form; store it again under another path")
        known = [f for f in names if f.startswith("slots-")]
        self.spark = spark
        if known:
            self.buckets, self.parts = map(int, known[0].removeprefix("slots-").split("-"))
        else:
            partitions = int(spark.conf.get(_PARTITIONS))
            self.buckets = buckets or partitions
            self.parts = max(self.buckets, partitions)
        self.path = f"{path.rstrip('/')}/slots-{self.buckets}-{self.parts}"
        self.name = f"inktally_load_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        if not spark.catalog.tableExists(self.name):
            place = self.path.replace("\\", "\\\\").replace("'", "\\'")
            columns = "slot binary, schema string, table string, row_hash binary, copies bigint, mark string"
            how = f"using parquet options (compression 'zstd') clustered by (slot) into {self.parts} buckets"
            spark.sql(f"create table {self.name} ({columns}) {how} location '{place}'")

    def store(self, documents: DataFrame) -> LoadedVersion:
        """Keeps a load; a version holds one. Tasks write the parts that they have folded."""
        with _dealt(self.spark, self.parts):
            folded(documents).write.insertInto(self.name, overwrite=True)
        return self

    @property
    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)


def changes(before: LoadedVersion, documents: DataFrame) -> DataFrame:
    """(schema, table, doc_id, row_hash, change, copies_before, copies_after) of whatever is not as it was.

    ``change`` is ``added``, ``removed`` or ``changed``; in a table without a key, rows are added and removed as often as
    their counts differ.  ``row_hash`` is the new one, of what was removed the old one; of rows that share
    a key, the smallest.
    """
    old, new = before.rows.alias("o"), folded(documents).alias("n")
    both = old.join(new, "slot", "full_outer")
    was, now = (F.coalesce(F.col(f"{side}.copies"), F.lit(0)) for side in "on")
    alike = F.col("o.row_hash").eqNullSafe(F.col("n.row_hash"))
    same = (was == now) & alike & F.col("o.mark").eqNullSafe(F.col("n.mark"))
    change = (
        F.when(was == 0, "added")
        .when(now == 0, "removed")
        .when(alike & (was < now), "added")
        .when(alike & (was > now), "removed")
        .when(~same, "changed")
    )
    text = lambda c: F.lower(F.hex(c))
    found = both.select(
        "slot",
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in (*_TABLE, "row_hash")],
        change.alias("change"),
        was.alias("copies_before"),
        now.alias("copies_after"),
    ).where(F.col("change").isNotNull())
    row_hash = F.coalesce("row_hash", F.substring("slot", _HASH + 1, _HASH))
    return found.select(
        *_TABLE, text(F.substring("slot", 1, _HASH)).alias("doc_id"), text(row_hash).alias("row_hash"), "change", "copies_before", "copies_after"
    )


def change_counts(found: DataFrame) -> DataFrame:
    """Rows added, removed and changed in each table."""
    difference = F.abs(F.col("copies_after") - F.col("copies_before"))

    def count(kind: str) -> object:
        rows = F.col("copies_after") if kind == "changed" else difference
        return F.coalesce(F.sum(F.when(F.col("change") == kind, rows)), F.lit(0)).alias(kind)

    return found.groupBy(*_TABLE).agg(*[count(k) for k in ("added", "removed", "changed")])
