"""Contiguous shards of about equal bytes, by prefix sums over all rows.

Rows are put in the order of doc_id, checksum and size, by ranges that are written out sorted. Each range's
totals, one number each, give it its offset, and a running sum inside it gives each row its
place in the whole. The bytes are then cut at equal targets: a row is in the shard in which its middle lies, so
shards are contiguous and differ from the target by less than a row. Texts are not shuffled. Ranges are cut inside
a doc_id too, so that one with very many rows, or none of them having an id, fills no task.

Defined results: a null text has no bytes and counts as the fixed size only; a null doc_id comes first;
rows that share a doc_id are ordered by checksum and size, and equal rows, which are counted before they are
shuffled, follow each other; no rows give no rows. Equal texts need not share a shard. Only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inktally.llm.common import shared_folder, stored
from inktally.operators.ordering import sorted_ranges

#: Copies of a row that a task writes out at a time.
COPIES = 10_000


def sharded(docs: DataFrame, shards: int = 24, fixed: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; slot numbers a shard's rows from 0 without gaps."""
    body = F.coalesce("text", F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + fixed).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    shared_folder(docs.sparkSession)
    counted = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    order = [F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = sorted_ranges(counted, order, "sizes")

    # One row for each written range: as many as shuffle partitions, whatever the data.
    totals = rows.groupBy("_range").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")).collect()
    offsets, bytes_, count = [], 0, 0
    for t in sorted(totals, key=lambda t: t["_range"]):
        offsets.append((t["_range"], bytes_, count))
        bytes_, count = bytes_ + t["bytes"], count + t["rows"]
    known = docs.sparkSession.createDataFrame(offsets, "_range int, bytes_before long, rows_before long")

    up_to = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    block = F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}L))")
    copy = F.expr(f"explode(sequence(block * {COPIES}L, least(copies, (block + 1) * {COPIES}L) - 1))")
    placed = (
        rows.withColumn("bytes_after", F.sum(F.col("size") * F.col("copies")).over(up_to))
        .withColumn("rows_after", F.sum("copies").over(up_to))
        .join(F.broadcast(known), "_range")
        .withColumn("block", block)
        .repartition("doc_id", "text_crc32", "block")  # copies of one row are written out by many tasks
        .withColumn("copy", copy)
        .withColumn("at", F.expr("bytes_before + bytes_after - (copies - copy) * size"))
        .withColumn("nth", F.expr("rows_before + rows_after - copies + copy"))
        .withColumn("shard", F.expr(f"cast(((2 * at + size) * {shards}) div (2 * {max(1, bytes_)}L) as int)"))
    )
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "nth"), "places")
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )
