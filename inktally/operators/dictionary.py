"""Token counts of pieces that are kept from one estimate to the next.

Texts of a language share their pieces, and so do the tables of a week with those of the week before. The
dictionary is a table of pieces and their token counts, bucketed by piece. An estimate joins its pieces with it and
sends only those to the tokenizer library that it lacks; these are added. Only the estimate's side of the joins is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.operators.tokens import Tokenizer
from inktally.sources.scratch import exists, folders, written
from inktally.sources.small import small_frame


class PieceDictionary:
    """A dictionary for one tokenizer under ``path``; it is made, with the vocabulary in it, where there is none.

    ``buckets`` holds for a new one; one that is there keeps its number.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer, buckets: int = 64):
        self.spark, self.tokenizer = spark, tokenizer
        place = f"{path.rstrip('/')}/{tokenizer.name}"
        known = [f for f in (folders(spark, place) if exists(spark, place) else []) if f.startswith("buckets-")]
        self.buckets = int(known[0].removeprefix("buckets-")) if known else buckets
        self.path = f"{place}/buckets-{self.buckets}"
        # The session's catalog is where Spark looks up that files are bucketed.
        self.name = f"inktally_pieces_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"create table {self.name} (piece string, length bigint) using parquet "
                f"clustered by (piece) into {self.buckets} buckets location '{_quoted(self.path)}'"
            )
        if not known:
            whole = [(text, 1) for text in map(_text, tokenizer.ranks) if text]
            self._append(small_frame(spark, whole, "piece string, length bigint"))

    def _append(self, pieces: DataFrame) -> None:
        dealt = pieces.select("piece", F.col("length").cast("bigint").alias("length")).repartition(self.buckets, "piece")
        dealt.write.insertInto(self.name)

    def lengths(self) -> DataFrame:
        """``piece`` and ``length``, each piece once whoever added it; the buckets spare the shuffle."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).groupBy("piece").agg(F.min("length").alias("length"))

    def unknown(self, counts: DataFrame) -> DataFrame:
        """The pieces of :func:`piece_counts` that the dictionary lacks."""
        pieces = counts.where("piece is not null").select("piece").distinct()
        return pieces.join(self.lengths(), "piece", "left_anti")

    def learn(self, counts: DataFrame) -> int:
        """Adds the pieces that the dictionary lacks; only these reach the tokenizer library.  Returns how many there are."""
        new = written(self.unknown(counts), "unknown-pieces")
        n = new.count()
        if n:
            length: Column = self.tokenizer.counter(self.spark)(F.col("piece"))
            self._append(new.repartition(self.buckets, "piece").withColumn("length", length))
        return n

    def tokens(self, counts: DataFrame, by: tuple[str, ...] = ("schema", "table")) -> DataFrame:
        """Documents and token totals per group of pieces that the dictionary knows.

        Like :func:`piece_tokens`; a piece that it does not know fails the job.
        """
        found = counts.join(self.lengths(), "piece", "left")
        missing = F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col("piece"))).cast("bigint")
        length = F.when(F.col("piece").isNull(), 0).otherwise(F.coalesce("length", missing))
        return found.groupBy(*by).agg(
            F.sum(F.when(F.col("piece").isNull(), F.col("piece_count")).otherwise(0)).alias("row_count"),
            F.coalesce(F.sum(length * F.col("piece_count")), F.lit(0)).cast("bigint").alias("token_count"),
        )


def _text(token: bytes) -> str:
    """A token as text; empty if it is none by itself."""
    try:
        return token.decode()
    except UnicodeDecodeError:
        return ""


def _quoted(path: str) -> str:
    return path.replace("\\", "\\\\").replace("'", "\\'")
