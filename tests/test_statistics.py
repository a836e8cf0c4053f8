"""Profiles from file statistics equal those from scans, and read no more than they have to."""

import random
from datetime import date, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inktally.operators import statistics
from inktally.operators.profile import table_snapshots
from inktally.operators.statistics import footer_session, from_footers, snapshots_from_statistics, with_leading_nines
from inktally.spec import TableSpec


def same_as_scans(spark, tables):
    scans = table_snapshots([(spark.read.parquet(path), spec) for path, spec in tables])
    found = snapshots_from_statistics(spark, tables)
    assert found.columns == scans.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, scans.collect()), key=repr)
    return {row["table"]: row for row in found.collect()}


def saved(spark, path, frame, name, pk=(), **options):
    frame.write.options(**options).parquet(str(path / name))
    return str(path / name), TableSpec.of(frame.schema, name, pk=pk)


def test_every_kind_of_key_and_change(spark, tmp_path):
    ids = spark.range(0, 25_000, 1, 5)
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 777).cast("int")).alias("updated_at")
    time = F.timestamp_millis(F.col("id") * 1001).alias("updated_at")
    signed = (F.col("id") - 24_990).cast("int").alias("k")
    tables = [
        saved(spark, tmp_path, ids.select("id", day), "dense", ("id",)),
        saved(spark, tmp_path, ids.select(F.xxhash64("id").alias("id"), time), "hashes", ("id",)),
        saved(spark, tmp_path, ids.select(signed, time), "signed", ("k",)),
        saved(spark, tmp_path, ids.select((-1 - F.col("id")).alias("k"), day), "negative", ("k",)),
        saved(spark, tmp_path, ids.select((F.col("id") % 7).cast("byte").alias("k")), "bytes", ("k",)),
        saved(spark, tmp_path, ids.select("id", F.col("id").cast("string").alias("t"), day), "pair", ("t", "id")),
        saved(spark, tmp_path, ids.select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), day), "nulls", ("k",)),
        saved(spark, tmp_path, ids.select(F.lit(None).cast("long").alias("k"), F.lit(None).cast("date").alias("updated_at")), "none", ("k",)),
        saved(spark, tmp_path, ids.where("id < 0").select("id", day), "empty", ("id",)),
        saved(spark, tmp_path, ids.select(day), "keyless"),
        saved(spark, tmp_path, ids.select(F.col("id").alias("a`b"), day), "odd", ("a`b",)),
        saved(spark, tmp_path, ids.select("id", F.col("id").cast("string").alias("updated_at")), "texts", ("id",)),
        saved(spark, tmp_path, ids.select("id", day), "parts", ("id",)),
    ]
    found = same_as_scans(spark, tables)
    assert found["dense"]["max_pk_lexicographic"] == "9999" and found["dense"]["max_updated_at"].startswith("2026-02-15")
    assert found["none"]["max_pk_lexicographic"] == "" and found["empty"]["max_pk_lexicographic"] is None


def test_files_without_statistics_are_scanned(spark, tmp_path):
    rows = pa.table({"id": pa.array(range(500), pa.int64()), "updated_at": pa.array([datetime(2024, 5, 6)] * 500, pa.date32())})
    pq.write_table(rows, tmp_path / "bare.parquet", write_statistics=False)
    frame = spark.read.parquet(str(tmp_path / "bare.parquet"))
    same_as_scans(spark, [(str(tmp_path / "bare.parquet"), TableSpec.of(frame.schema, "bare", pk=("id",)))])


def test_no_tables(spark):
    assert snapshots_from_statistics(spark, []).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_leading_nines(spark, seed):
    """Keys with the leading digits are those, and the largest text is among them if there are any."""
    draw = random.Random(seed)
    keys = [draw.randrange(10 ** draw.randint(1, 18)) for _ in range(300)] + [9, 99, 989, 990, 999, 1000, 2**63 - 1]
    for digits in (1, 2, 3):
        frame = spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1)
        found = {r.k for r in frame.where(with_leading_nines(F.col("k"), digits, max(keys))).collect()}
        assert found == {k for k in keys if str(k).startswith("9" * digits)}


def test_footers_answer_without_data_pages(spark, tmp_path):
    ids = spark.range(0, 40_000, 1, 2)
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 100).cast("int")).alias("updated_at")
    path, spec = saved(spark, tmp_path, ids.select("id", day), "t", ("id",))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    session = footer_session(spark)
    plan = from_footers(session.read.parquet(path), spec)._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MAX(updated_at), MAX(id)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_the_largest_text_reads_few_rows(spark, tmp_path, monkeypatch):
    """Of a sorted table the key's largest text is found among the rows of few row groups."""
    path, spec = saved(
        spark, tmp_path, spark.range(0, 200_000, 1, 1).toDF("id"), "t", ("id",), **{"parquet.block.size": "20000"}
    )
    groups = sum(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "t").glob("*.parquet"))
    assert groups > 20
    session = footer_session(spark)
    seen = []
    original = statistics.with_leading_nines
    monkeypatch.setattr(statistics, "with_leading_nines", lambda *a: seen.append(a[1:]) or original(*a))
    assert snapshots_from_statistics(spark, [(path, spec)]).first()["max_pk_lexicographic"] == "99999"
    assert seen == [(5, 199_999)]
    kept = session.read.parquet(path).where(original(F.col("id"), 5, 199_999))
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() < 40_000
    assert "PushedFilters" in kept._jdf.queryExecution().toString()
