import pytest
from pyspark.sql import functions as F

from inktally.operators import places, profile, slices
from inktally.operators.documents import RowText
from inktally.operators.ordering import ranked, running_totals, sample_size, sorted_ranges, without_repeats
from inktally.spec import TableSpec


def numbers(spark, n=5000, parts=7):
    frame = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).cast("int").alias("v"))
    frame = frame.repartition(parts)
    return frame, TableSpec.of(frame.schema, "t", pk=("k",))


def test_rank_equals_place_in_the_order(spark):
    frame, _ = numbers(spark)
    rows = ranked(frame, [F.col("k")]).collect()
    assert len(rows) == 5000 and all(r["rank"] == r["k"] for r in rows)


def test_rank_splits_a_hot_key(spark):
    # One key holds all rows: the ranges still share them out.
    frame = spark.range(4000).select(F.lit(1).alias("k"), "id").repartition(4)
    rows = ranked(frame, [F.col("k")])
    assert sorted(r["rank"] for r in rows.collect()) == list(range(4000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted_ranges(frame, [F.col("k")], "hot").groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000


def test_no_window_without_partitions(spark):
    frame, spec = numbers(spark)
    plan = slices.chunk_estimates(frame, spec, F.col("v"), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("few", [20_000, 40])
@pytest.mark.parametrize("offset,limit", [(0, 10), (100, 50), (4990, 100), (6000, 5), (10, 0), (0, -1), (0, 5000)])
def test_slices(spark, monkeypatch, offset, limit, few):
    monkeypatch.setattr(places, "FEW", few)
    monkeypatch.setattr(places, "CUTS", 20)
    frame, spec = numbers(spark)
    found = slices.ordered_slice(frame, spec, offset, limit)
    assert [r.k for r in found.collect()] == list(range(5000))[offset : offset + max(limit, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Window" not in plan


@pytest.mark.parametrize("few", [20_000, 20])
def test_slices_of_equal_keys_and_equal_rows(spark, monkeypatch, few):
    """Slices next to each other make up the table, however its rows are spread."""
    monkeypatch.setattr(places, "FEW", few)
    monkeypatch.setattr(places, "CUTS", 8)
    rows = [(1, f"v{i % 40}") for i in range(200)] + [(None, "n")] * 30 + [(2, None)] * 25
    spec, parts = None, []
    for split in (1, 5):
        frame = spark.createDataFrame(rows, "k int, v string").repartition(split)
        spec = TableSpec.of(frame.schema, "t", pk=("k",))
        parts.append([tuple(r) for at in range(0, 260, 65) for r in slices.ordered_slice(frame, spec, at, 65).collect()])
    assert parts[0] == parts[1] and sorted(parts[0], key=repr) == sorted(rows, key=repr)
    assert [k for k, _ in parts[0]] == [1] * 200 + [2] * 25 + [None] * 30


def test_a_place_is_sought_by_the_first_column(spark, monkeypatch):
    """The other order columns are read of rows that share its value only; both ends of a slice take few scans."""
    monkeypatch.setattr(places, "FEW", 40)
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def later(k):
        read.add(1)
        return k % 3

    frame = spark.range(0, 5000, 1, 3).select((F.col("id") * 7919 % 5000).alias("k"), later("id").alias("v"))
    spec = TableSpec.of(frame.schema, "t")
    found = slices.ordered_slice(frame, spec, 3000, 1000)
    assert read.value < 100
    assert [r.k for r in found.collect()] == list(range(3000, 4000))


def test_long_keys_are_cut_too(spark, monkeypatch):
    """Keys too long to be gathered beside their sizes take the other way."""
    monkeypatch.setattr(places, "FEW", 40)
    monkeypatch.setattr(places, "SAMPLE_BYTES", 20_000)
    frame = spark.range(3000).select(F.concat(F.lit("x" * 100), F.format_string("%04d", F.col("id") * 7 % 3000)).alias("k"))
    found = slices.ordered_slice(frame, TableSpec.of(frame.schema, "t", pk=("k",)), 1500, 3).collect()
    assert [r.k[-4:] for r in found] == ["1500", "1501", "1502"]


def test_bounded_scan_without_limit(spark):
    frame, spec = numbers(spark)
    assert [r.k for r in slices.bounded_scan(frame, spec).collect()] == list(range(5000))
    assert [r.k for r in slices.bounded_scan(frame, spec, 4990).collect()] == list(range(4990, 5000))
    assert slices.bounded_scan(frame, spec, 5000).count() == 0


def test_slices_put_nulls_last(spark):
    frame = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    spec = TableSpec.of(frame.schema, "t", pk=("k",))
    assert [r.k for r in slices.ordered_slice(frame, spec, 0, 2).collect()] == [1, 2]
    assert [r.chunk_id for r in slices.chunk_estimates(frame, spec, F.lit(1), 2).collect()] != []


def snapshots(spark, *counts):
    rows = [("public", f"t{n}", n) for n in counts]
    return spark.createDataFrame(rows, "schema string, table string, row_count bigint")


def test_chunk_plan(spark):
    plan = slices.chunk_plan(snapshots(spark, 0, 49_999, 50_000, 50_001))
    sizes = {r.table: r["count"] for r in plan.groupBy("table").count().collect()}
    assert sizes == {"t0": 1, "t49999": 1, "t50000": 5, "t50001": 6}
    last = plan.where(F.col("chunk_id") == "public.t50001#5").first()
    assert (last.offset_start, last.row_limit, last.n_chunks) == (50_000, 10_000, 6)
    whole = plan.where("table = 't0'").first()
    assert (whole.chunk_id, whole.row_limit) == (None, None)
    assert slices.chunk_plan(snapshots(spark, 90_000), chunk_rows=0).count() == 1


@pytest.mark.parametrize("size", [1, 7, 1000, 9999])
def test_chunks_add_up_to_the_table(spark, size):
    frame, spec = numbers(spark, 600, 5)
    chunks = slices.chunk_estimates(frame, spec, F.col("v"), size)
    total = chunks.agg(F.sum("row_count"), F.sum("token_count")).first()
    assert tuple(total) == (600, 600) and chunks.count() == -(-600 // size)


def test_chunks_of_a_table_without_key_and_equal_rows(spark):
    frame = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "s string").repartition(5)
    spec = TableSpec.of(frame.schema, "t")
    found = slices.chunk_estimates(frame, spec, F.ascii("s"), 30).orderBy("chunk_index").collect()
    assert [(r.row_count, r.token_count) for r in found] == [
        (30, 30 * 97), (30, 20 * 97 + 10 * 98), (30, 30 * 98), (10, 10 * 98),
    ]


def test_merge_waits_for_all_chunks(spark):
    chunks = spark.createDataFrame(
        [("s", "t", "s.t#0", 10, 4), ("s", "t", "s.t#1", 10, 6), ("s", "t", "s.t#1", 10, 6), ("s", "t", "s.t#2", 3, 1)],
        "schema string, table string, chunk_id string, row_count bigint, token_count bigint",
    )
    plan = spark.createDataFrame(
        [("s", "t", f"s.t#{i}", 3) for i in range(3)], "schema string, table string, chunk_id string, n_chunks bigint"
    )
    assert [tuple(r) for r in slices.merge_chunks(chunks, plan).collect()] == [("s", "t", 23, 11)]
    partial = chunks.where("chunk_id <> 's.t#2'")
    assert slices.merge_chunks(partial, plan).count() == 0
    assert slices.chunk_progress(partial, plan).first().label == "2/3"


def test_snapshot(spark):
    frame = spark.sql("select * from values (9, 'x', timestamp_ntz'2024-01-01 00:00:00.5'), "
                      "(10, null, timestamp_ntz'2023-01-01 00:00:00') as t(a, b, updated_at)")
    spec = TableSpec.of(frame.schema, "t", pk=("a", "b"))
    found = profile.table_snapshots([(frame, spec), (frame.limit(0), TableSpec.of(frame.schema, "e"))]).collect()
    assert tuple(found[0]) == ("public", "t", 2, "2024-01-01T00:00:00.500Z", "9|x")
    assert tuple(found[1]) == ("public", "e", 0, None, None)
    counts = profile.row_counts([(frame, spec)])
    assert profile.large_tables(counts, 2).count() == 1 and profile.large_tables(counts, 3).count() == 0


def test_newest_change_of_a_text_column(spark):
    """The largest text is read as a date; it need not be one."""
    frame = spark.createDataFrame([("2024-01-02 03:04:05",), ("2023-12-31",), (None,)], "updated_at string")
    spec = TableSpec.of(frame.schema, "t")
    assert profile.table_snapshot(frame, spec).first().max_updated_at == "2024-01-02T03:04:05.000Z"
    odd = frame.unionByName(spark.createDataFrame([("later",)], "updated_at string"))
    assert profile.table_snapshot(odd, spec).first().max_updated_at is None


def test_samples_of_long_keys_are_smaller(spark):
    assert sample_size(10, 200) == 100 and sample_size(1 << 20, 200) == 2
    assert sample_size(50_000, 4) == 100 and 20 < sample_size(10_000, 80) < 30
    from inktally.operators import ordering

    before = spark.conf.get(ordering._SAMPLE)
    frame = spark.createDataFrame([("x" * 1000, i) for i in range(50)], "s string, i int")
    assert ranked(frame, [F.col("s"), F.col("i")]).count() == 50 and spark.conf.get(ordering._SAMPLE) == before


def test_chunks_do_not_depend_on_the_layout(spark):
    rows = [(i // 50, f"x{i % 13}") for i in range(300)]
    made = []
    for split in (1, 6):
        frame = spark.createDataFrame(rows, "k int, v string").repartition(split)
        spec = TableSpec.of(frame.schema, "t", pk=("k",))
        made.append(sorted(map(tuple, slices.chunk_estimates(frame, spec, F.length("v"), 70).collect())))
    assert made[0] == made[1]


def test_running_totals_with_a_hot_group(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 10).alias("g"), F.col("id").alias("o")
    ).repartition(5)
    rows = running_totals(frame, "g", [F.col("o")], {"n": F.lit(1), "s": F.col("o")}).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.o):
        n, s = seen.get(r.g, (0, 0))
        seen[r.g] = (n + 1, s + r.o)
        assert (r.n, r.s) == seen[r.g]
    assert len(rows) == 3000


def test_repeats_across_ranges(spark):
    frame = spark.range(3000).select(
        (F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.floor(F.col("id") / 500).alias("v")
    ).repartition(5)
    kept = without_repeats(frame, "g", [F.col("o")], ["v"]).collect()
    assert sorted((r.g, r.o) for r in kept) == sorted((g, 500 * i + g) for g in (0, 1) for i in range(6))


def test_chunks_carry_texts(spark):
    frame = spark.createDataFrame([(i, "x" * i) for i in range(1, 6)], "k int, s string")
    spec = TableSpec.of(frame.schema, "t", pk=("k",))
    texts = RowText(frame, spec).texts
    found = slices.chunk_estimates(texts, spec, F.length("page_content"), 2).orderBy("chunk_index").collect()
    assert [r.token_count for r in found] == [3 * 2 + 3, 3 * 2 + 7, 3 + 5]
