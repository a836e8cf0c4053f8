"""Lines that an earlier document already holds, found with levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. A batch's line keys are merge-anti-joined with the runs of
earlier batches; what is new becomes a sorted run of its own. When a level has ``fanout`` runs, they are
merged into one run of the next level, so a batch never meets more than ``fanout * log(batches)`` runs.

Defined results: a null text is one empty line; a null doc_id comes after all others, and all rows with a
null doc_id count as one document, as do rows that share a doc_id; repeated rows are all returned, with the
same result; no rows give no rows. Extra columns pass through; of the columns named like a result, the result
stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.llm.common import LAST_ID, ascii_lower, bucketed, stored, whole_row, with_results

BLANKS = " \t\n\x0b\x0c\r"
#: The 128 bits of a line's key.
HASHES = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks at both ends and the case of A-Z don't count."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_id() -> Column:
    """Tells rows of one doc_id apart; equal rows share it, and their result."""
    return F.xxhash64(F.lit(1), F.coalesce(F.col("text"), F.lit("")))


def _line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row per line that is long enough: where it is, and 128 bits of its key."""
    lines = docs.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        _row_id().alias("row"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class Runs:
    """Levels of runs, tables bucketed and sorted by line hash; every key is in one run only.

    All have the same buckets, so that a batch dealt by hash meets them, and they are merged, without a shuffle of runs.
    """

    def __init__(self, spark: SparkSession, fanout: int) -> None:
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def table(self, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
        """Rows bucketed by hash, as a table and as the path of its files."""
        name, path = bucketed(rows, label, HASHES)
        self.names.append(name)
        return self.spark.table(name), path

    def marked(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``known``: whether a run has the key; one run after the other is merged in."""
        known = F.lit(False)
        for place, run in enumerate(run for level in self.levels for run in level):
            mark = f"in_{place}"
            keys = keys.join(run.select(*HASHES, F.lit(True).alias(mark)).hint("merge"), HASHES, "left")
            known = known | F.col(mark).isNotNull()
        return keys.select(*HASHES, "first", "last", known.alias("known"))

    def add(self, run: DataFrame, at: int = 0) -> None:
        """A new run; compacts the level if it is full."""
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(run)
        if len(self.levels[at]) == self.fanout:
            full, self.levels[at] = reduce(DataFrame.unionByName, self.levels[at]), []
            # Spark sees the buckets of a union whose parts keep the columns that they read, ``known`` among them.
            merged = full.groupBy(*HASHES).agg(F.max("known").alias("known"))
            self.add(self.table(merged, "run")[0], at + 1)

    def forget(self) -> None:
        """Takes the tables out of the session's catalog."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut the documents into about equal batches; any cuts give the same result."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] if shares else None
    return sorted(set(found or []))


def repeated_lines(docs: DataFrame, least_chars: int, batches: int, fanout: int) -> DataFrame:
    """(doc, row, dropped): the positions of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    runs, found = Runs(spark, fanout), None
    cuts = _bounds(docs, batches)
    doc = F.coalesce("doc_id", F.lit(LAST_ID))
    for after, upto in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs
        if after is not None:
            batch = batch.where(doc > after)
        if upto is not None:
            batch = batch.where(doc <= upto)
        lines = stored(_line_hashes(batch, least_chars), "lines")
        keys = lines.groupBy(*HASHES).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        keys, path = runs.table(runs.marked(keys), "keys")
        if upto is not None:
            runs.add(keys.where(~F.col("known")).select(*HASHES, "known"))
        # Read as plain files, so that adaptive execution may split a line that very many documents have.
        repeated = spark.read.schema(keys.schema).parquet(path).where("known or first < last")
        gone = lines.join(repeated, HASHES).where("known or doc > first")
        gone = gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        found = gone if found is None else found.unionByName(gone)
    runs.forget()
    return found


def _without(text: Column, dropped: Column) -> Column:
    """The text without the lines at the ascending positions ``dropped``, in linear time.

    The positions become a string of marks, as long as needed; lines and marks are then read side by side.
    """
    gaps = F.transform(
        dropped,
        lambda p, i: F.concat(
            F.repeat(F.lit("0"), p - F.when(i > 0, F.element_at(dropped, i)).otherwise(F.lit(-1)) - 1), F.lit("1")
        ),
    )
    marks = F.split(F.array_join(gaps, ""), "", -1)
    kept = F.zip_with(F.split(text, "\n", -1), marks, lambda line, mark: F.when(mark == "1", None).otherwise(line))
    return F.array_join(kept, "\n")


def without_repeated_lines(
    docs: DataFrame, least_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """The documents and ``kept`` (the text without lines that a smaller doc_id holds), ``n_lines``, ``n_dropped``."""
    gone = repeated_lines(docs.select("doc_id", "text"), least_chars, batches, fanout)
    text = F.coalesce("text", F.lit(""))
    rows = whole_row(
        docs, F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), _row_id().alias("row"), text.alias("body")
    )
    both = rows.join(gone, ["doc", "row"], "left")
    body, dropped = F.col("body"), F.col("dropped")
    line_ends = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    return with_results(
        both,
        docs.columns,
        kept=F.when(dropped.isNull(), body).otherwise(_without(body, dropped)),
        n_lines=(line_ends + 1).cast("long"),
        n_dropped=F.coalesce(F.size(dropped), F.lit(0)).cast("long"),
    )
