"""Vector codes: each vector is cut into parts, and each part replaced by the nearest entry of its position's codebook.

Codebooks are fitted by Lloyd's rounds over members that stay where they are. Parts are rows of a table that is
bucketed by their owner, (position, entry, salt). In a round

1. owners sum up their resident members; the table's buckets are theirs, so no member is shuffled for it, and
   the driver gets one row of sums per entry, from which the new codebooks are made;
2. every member looks for its nearest entry. Those that stay are written back by the task that holds them;
3. only those whose entry changes migrate: they are shuffled to the buckets of their new owners.

The salt splits an entry with many members: there is a salt for every four buckets, so that even with all parts
of a position at one entry no owner has more than a bucket's share. Vectors become whole numbers,
floor(scale * x), and all arithmetic on them is exact. Ties go to the entry with the lower index.

Codebooks start as the parts of the vectors with the smallest keys. Defined results: rows whose vector is null or
has null or non-finite components are dropped; rows with a null key come after all others where codebooks start, and
rows with equal keys are separate ones in the order of their vectors; fewer rows than entries make smaller
codebooks; empty vectors have empty parts and no error; no rows give no rows. Vectors of several lengths, or of one
that the number of parts does not divide, raise ValueError; components of 2**42 and more, and distances beyond 64 bits,
fail the job. Extra
columns pass through; of the columns named like a result, the result stays.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.llm.common import bare_name, new_path, sent, stored, with_results

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: What a part belongs to; the members' table is bucketed by it.
OWNER = ("position", "entry", "salt")
#: Parts whose distances are computed at once.
BLOCK = 1 << 12


@dataclass(frozen=True)
class Codebooks:
    """The entries of each position, whole numbers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by position, entry and place, as decimal numbers between commas."""
        numbers = ",".join(str(int(x)) for book in self.entries for x in book.ravel())
        return hashlib.sha256(numbers.encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, of equally near ones the first, and the squared distance; exact."""
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    reach = 4 * max(parts.shape[1], 1) * largest**2
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    entries = book.astype(kind)
    own = (entries * entries).sum(axis=1)
    at, far = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    for first in range(0, len(parts), BLOCK):
        some = parts[first : first + BLOCK].astype(kind)
        distance = own - 2 * (some @ entries.T) + (some * some).sum(axis=1)[:, None]
        best = distance.argmin(axis=1)
        at[first : first + BLOCK] = best
        far[first : first + BLOCK] = distance[np.arange(len(some)), best]
    return at, far


def whole_numbers(vector: Column, scale: int) -> Column:
    def one(x: Column) -> Column:
        value = x.cast("double")
        too_large = F.raise_error(F.lit("a component of 2**42 or more"))
        return F.when(F.abs(value) >= float(1 << 42), too_large).otherwise(F.floor(F.lit(float(scale)) * value)).cast("long")

    return F.transform(vector, one)


def _whole(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def with_nearest(parts: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of ``parts`` (position, part and others) with ``next``, their nearest entry, and ``distance``."""
    shared = sent(parts.sparkSession, books.entries)
    out = T.StructType([*parts.schema.fields, T.StructField("next", T.IntegerType()), T.StructField("distance", T.LongType())])
    of_position, of_part = parts.columns.index("position"), parts.columns.index("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared()
        width = entries[0].shape[1]
        for batch in batches:
            position = batch.column(of_position).to_numpy(zero_copy_only=False)
            values = batch.column(of_part).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            at, far = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for p, book in enumerate(entries):
                here = position == p
                at[here], far[here] = nearest(values[here], book)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], names=out.fieldNames())

    return parts.mapInArrow(run, out)


class Members:
    """The parts, resident in buckets of their owners; a table in the shared folder for each round."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.name, self.path = None, None
        self.moved: list[int] = []

    def _write(self, frame: DataFrame, name: str, path: str, mode: str) -> None:
        columns = ("row", *OWNER, "next", "part", "kind")
        writer = frame.select(*columns).write.mode(mode).option("path", path).option("compression", "zstd")
        writer.partitionBy("kind").bucketBy(self.buckets, *OWNER).saveAsTable(name)

    def _dealt(self, frame: DataFrame) -> DataFrame:
        """Parts on their way to the owners of their ``next`` entries."""
        came = frame.withColumn("entry", F.col("next")).withColumn("kind", F.lit("came"))
        return came.repartition(self.buckets, *OWNER)

    def resident(self) -> DataFrame:
        return self.spark.table(self.name).where("kind <> 'left'").drop("kind", "next")

    def start(self, parts: DataFrame, books: Codebooks) -> None:
        """Deals all parts to the owners of their nearest entries."""
        salt = F.pmod(F.xxhash64("row", "position"), F.lit(max(1, self.buckets // PARTS))).cast("int")
        self._replace(lambda name, path: self._write(self._dealt(with_nearest(parts.withColumn("salt", salt), books)), name, path, "error"))

    def move(self, books: Codebooks) -> None:
        """Members whose nearest entry is another one go to its owner; the others stay where they are."""

        def write(name: str, path: str) -> None:
            kind = F.when(F.col("next") == F.col("entry"), "stay").otherwise("left")
            self._write(with_nearest(self.resident(), books).withColumn("kind", kind), name, path, "error")
            left = self.spark.table(name).where("kind = 'left'")
            self.moved.append(left.count())
            self._write(self._dealt(left), name, path, "append")

        self._replace(write)

    def _replace(self, write: Callable[[str, str], None]) -> None:
        """A new table takes the place of the round before's, which is removed once it is written."""
        name, path = f"inktally_members_{uuid.uuid4().hex}", new_path(self.spark, "members")
        write(name, path)
        self.remove()
        self.name, self.path = name, path

    def remove(self) -> None:
        if self.name:
            self.spark.sql(f"drop table {self.name}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            self.name = None

    def sums(self, width: int) -> DataFrame:
        """Count and sums of each owner's members; grouped as the table is bucketed, so that no member is shuffled."""
        each = [F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)]
        return self.resident().groupBy(*OWNER).agg(F.count("*").alias("n"), *each)

    def updated(self, books: Codebooks) -> Codebooks:
        """Each entry becomes the rounded-down mean of its members; one without members stays as it is."""
        entries = [book.copy() for book in books.entries]
        names = [f"s{i}" for i in range(entries[0].shape[1])]
        whole = self.sums(len(names)).groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        for row in whole.collect():  # one row an entry
            entries[row["position"]][row["entry"]] = [row[s] // row["n"] for s in names]
        return Codebooks(entries)


def first_books(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the first vectors in the order of (key, values)."""
    rows = kept.orderBy(F.col("key").asc_nulls_last(), "values").limit(entries).select("values").collect()
    whole = np.array([r["values"] for r in rows], np.int64).reshape(len(rows), -1)
    return Codebooks(np.split(whole, parts, axis=1))


def fitted(
    kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, buckets: int | None = None
) -> tuple[DataFrame, Codebooks, list[int]]:
    """(row, code, error) of the rows of ``kept`` (row, key, values), the final codebooks, and how many parts moved in each round."""
    spark = kept.sparkSession
    size = kept.agg(F.min(F.size("values")).alias("low"), F.max(F.size("values")).alias("high")).first()
    if size["low"] is None:
        return spark.createDataFrame([], "row long, code array<int>, error long"), Codebooks([]), []
    if size["low"] != size["high"] or size["low"] % parts:
        raise ValueError(f"vectors have {size['low']} to {size['high']} components; all need the same number, a multiple of {parts}")
    width = size["low"] // parts
    cut = [F.slice("values", F.lit(p * width + 1), F.lit(width)) for p in range(parts)]
    dealt = kept.select("row", F.posexplode(F.array(*cut)).alias("position", "part"))
    books = first_books(kept, parts, entries)
    members = Members(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    members.start(dealt, books)
    books = members.updated(books)
    for _ in range(rounds - 1):
        members.move(books)
        books = members.updated(books)
    last = with_nearest(members.resident(), books).select("row", F.struct("position", "next").alias("at"), "distance")
    code = F.transform(F.array_sort(F.collect_list("at")), lambda a: a["next"]).alias("code")
    codes = stored(last.groupBy("row").agg(code, F.sum("distance").alias("error")), "codes")
    members.remove()
    return codes, books, members.moved


def coded(
    vectors: DataFrame,
    column: str = "embedding",
    key: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    buckets: int | None = None,
) -> tuple[DataFrame, Codebooks]:
    """The rows with whole vectors and ``code`` (an entry for each part) and ``error`` (squared distances summed), and the codebooks."""
    vector = F.col(bare_name(column))
    rest = F.struct(*[F.col(bare_name(c)) for c in vectors.columns]).alias("given")
    numbers = whole_numbers(vector, scale).alias("values")
    marked = vectors.where(_whole(vector)).select(rest, F.col(bare_name(key)).alias("key"), numbers, F.monotonically_increasing_id().alias("row"))
    kept = stored(marked, "vectors")
    codes, books, _ = fitted(kept.select("row", "key", "values"), parts, entries, rounds, buckets)
    both = kept.select("row", "given").join(codes, "row")
    return with_results(both, vectors.columns, code="code", error="error"), books
