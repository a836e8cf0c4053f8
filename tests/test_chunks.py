"""Key ranges, chunks that are counted range by range, and the dictionary of pieces."""

import time

import pytest
from pyspark.sql import functions as F

from inktally.operators import bounds, slices
from inktally.operators.dictionary import PieceDictionary
from inktally.operators.documents import RowText, page_texts
from inktally.operators.places import sort_key
from inktally.operators.tokens import Tokenizer, piece_counts, piece_tokens
from inktally.plans import estimate
from inktally.plans.chunks import ChunkLog, Chunking, KeyRanges, count_chunks, pending_ranges
from inktally.plans.estimate import TableSource, estimate_tables, estimate_with_dictionary, table_results
from inktally.spec import EstimateConfig, TableSpec
from workloads.queries import pairs_tokenizer
from workloads.tables import tables


def keyed(spark, rows, layout="k int, v string", pk=("k",), parts=3):
    frame = spark.createDataFrame(rows, layout).repartition(parts)
    return frame, TableSpec.of(frame.schema, "t", pk=pk)


MIXED = [(1, f"v{i % 40}") for i in range(200)] + [(None, "n")] * 30 + [(2, None)] * 25 + [(i, "x") for i in range(3, 60)]


@pytest.mark.parametrize("chunk,most", [(10, 64), (7, 5), (1000, 3), (1, 400)])
def test_ranges_chunks_and_slices(spark, tmp_path, chunk, most):
    """Equal keys, equal rows and null keys across the borders of ranges."""
    frame, spec = keyed(spark, MIXED)
    ranges = KeyRanges.write(frame, spec, str(tmp_path / "ranges"), chunk, most)
    assert len(ranges.starts) <= most and ranges.row_count == len(MIXED)
    assert [s["first_rank"] for s in ranges.starts] == list(range(0, len(MIXED), chunk * ranges.chunks_in_range))
    again = KeyRanges.read(spark, spec, str(tmp_path / "ranges"))
    assert again.starts == ranges.starts and again.chunk_rows == chunk
    if len(ranges.starts) < 50:
        tokens = F.coalesce(F.length("v"), F.lit(0)) + F.coalesce("k", F.lit(100))
        counted = [r for i in range(len(ranges.starts)) for r in ranges.chunks(frame, tokens, i).collect()]
        whole = slices.chunk_estimates(frame, spec, tokens, chunk)
        assert sorted(map(tuple, counted)) == sorted(map(tuple, whole.collect()))
        plan = ranges.plan()
        assert {r.chunk_id for r in plan.collect()} == {r.chunk_id for r in counted}
        assert plan.where("range >= 0").count() == len(counted)
    got = [tuple(r) for at in (0, 65, 130, 260, 300) for r in ranges.slice(frame, at, 65).collect()]
    want = [tuple(r) for at in (0, 65, 130, 260, 300) for r in slices.ordered_slice(frame, spec, at, 65).collect()]
    assert [k for k, _ in got] == [k for k, _ in want] and len(got) == 65 * 3 + 52 + 12
    assert ranges.slice(frame, 10**6, 5).count() == 0 and ranges.slice(frame, 5, 0).count() == 0


def test_ranges_of_nothing(spark, tmp_path):
    frame, spec = keyed(spark, [])
    ranges = KeyRanges.write(frame, spec, str(tmp_path / "ranges"))
    assert ranges.starts == () and ranges.plan().count() == 0 and ranges.slice(frame, 0, 5).count() == 0
    with pytest.raises(ValueError):
        KeyRanges.write(frame, spec, str(tmp_path / "other"), 0)


@pytest.mark.parametrize("name", ["documents", "lineitem"])
def test_a_run_that_stops_goes_on(spark, data, tmp_path, name):
    """Two ranges are counted, then the rest, once each; the sum is the table's estimate."""
    used = pairs_tokenizer()
    ((frame, spec),) = tables(spark, data, (name,))
    ranges = KeyRanges.write(frame, spec, str(tmp_path / "ranges"), frame.count() // 17, 6)
    log, texts, tokens = ChunkLog(str(tmp_path / "log")), used.with_count(RowText(frame, spec).texts), F.col("token_count")
    seen = []
    assert count_chunks(texts, ranges, tokens, log, 5, most=2, ended=seen.append) == [0, 1] == seen
    done = log.read(spark, 5)
    half = done.count()
    (line,) = slices.chunk_progress(done, ranges.plan()).collect()
    assert 0 < line.completed_chunks == half < line.total_chunks
    assert slices.merge_chunks(done, ranges.plan()).count() == 0
    again = KeyRanges.read(spark, spec, str(tmp_path / "ranges"))
    rest = count_chunks(texts, again, tokens, log, 5, ended=seen.append)
    assert sorted(rest) == list(range(2, len(ranges.starts))) and sorted(seen) == list(range(len(ranges.starts)))
    assert pending_ranges(again, log.read(spark, 5)) == [] and count_chunks(texts, again, tokens, log, 5) == []
    logged = log.read(spark, 5)
    assert logged.count() == logged.select("chunk_id").distinct().count() == again.plan().count()
    (merged,) = slices.merge_chunks(logged, again.plan()).collect()
    (whole,) = estimate_tables([(frame, spec)], used).collect()
    assert tuple(merged) == tuple(whole)
    assert log.read(spark, 6).count() == 0


def test_a_range_reads_only_its_rows(spark, tmp_path):
    """Files sorted by their key: bounds of both key columns reach the scan, which leaves row groups out."""
    frame = spark.range(20_000).selectExpr("id div 500 as a", "id % 500 as b", "'x' as v").coalesce(1)
    frame.write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    spec = TableSpec.of(read.schema, "t", pk=("a", "b"))
    ranges = KeyRanges.write(read, spec, str(tmp_path / "ranges"), 1000, 10)
    for rows, most in ((ranges.between(read, 4, 4)[0], 6000), (slices.ordered_slice(read, spec, 10_000, 50), 3000), (slices.bounded_scan(read, spec, 19_900), 3000)):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "GreaterThan(a," in text and "GreaterThanOrEqual(b," in text
        assert _scanned(plan) < most


def _scanned(plan):
    """Rows that the scans of a plan gave out."""
    seen, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            seen += node.metrics().get("numOutputRows").get().value()
        if name.startswith("ShuffleQueryStage") or name.startswith("BroadcastQueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return seen


def test_bounds_of_compound_keys(spark):
    rows = [(a, b) for a in (None, 1, 2, 3) for b in (None, 1, 5)]
    frame = spark.createDataFrame(rows, "a int, b int")
    columns = [F.col("a"), F.col("b")]
    order = sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])
    for i, key in enumerate(order):
        place = lambda r: [(x is None, x or 0) for x in r]
        late = sorted([tuple(r) for r in frame.where(bounds.from_key(columns, key)).collect()], key=place)
        early = sorted([tuple(r) for r in frame.where(bounds.up_to_key(columns, key)).collect()], key=place)
        assert (late, early) == (order[i:], order[: i + 1])
    rows = frame.withColumn("_key", sort_key(columns))
    assert bounds.within(rows, columns, None, None).count() == 12


def test_large_tables_by_chunks(spark, data, tmp_path):
    """Results equal those of whole tables; the second run counts nothing; a changed table is told."""
    used = pairs_tokenizer()
    read = {s.table: (f, s) for f, s in tables(spark, data, ("orders", "nation", "labels"))}
    sources = [TableSource("public", n, lambda n=n: read[n]) for n in read]
    chunking = Chunking(str(tmp_path), 3, threshold=100, chunk_rows=60, most_ranges=3)
    want = sorted((r.table, r.row_count, r.token_count) for r in estimate_tables(list(read.values()), used).collect())
    for _ in range(2):
        found = table_results(spark, sources, used, chunking=chunking).collect()
        assert sorted((r.table, r.row_count, r.token_count) for r in found) == want
        logged = chunking.log.read(spark, 3)
        assert {r.table for r in logged.select("table").distinct().collect()} == {n for n, (f, _) in read.items() if f.count() >= 100}
        assert logged.count() == logged.select("chunk_id").distinct().count()
    smaller = TableSource("public", "orders", lambda: (read["orders"][0].limit(1200), read["orders"][1]))
    (row,) = table_results(spark, [smaller], used, chunking=chunking).collect()
    assert row.status == "error" and "begin a new run" in row.error_message


def test_later_chunks_win(spark):
    plan = spark.createDataFrame([("s", "t", "s.t#0", 1)], "schema string, table string, chunk_id string, n_chunks bigint")
    rows = [("s", "t", "s.t#0", 9, 90, "2024-01-01 00:00:00"), ("s", "t", "s.t#0", 8, 80, "2024-01-01 00:00:01")]
    layout = "schema string, table string, chunk_id string, row_count bigint, token_count bigint, completed_at string"
    arrived = spark.createDataFrame(rows, layout)
    assert tuple(slices.merge_chunks(arrived, plan).first()) == ("s", "t", 8, 80)
    assert tuple(slices.merge_chunks(arrived.drop("completed_at"), plan).first()) == ("s", "t", 9, 90)


def test_a_table_that_hangs_is_given_up(spark, tmp_path, tokenizer, monkeypatch):
    """One hangs in a job and one before any job; both get an error row, the others their estimates."""
    monkeypatch.setattr(estimate, "GRACE", 3.0)
    good = spark.createDataFrame([("x",), ("y z",)], "s string")
    slow = spark.range(1).select(F.udf(lambda _: time.sleep(300) or "x", "string")("id").alias("s"))
    found = [
        TableSource("public", "job", lambda: (slow, TableSpec.of(slow.schema, "job"))),
        TableSource("public", "load", lambda: time.sleep(300)),
        *[TableSource("public", f"good{i}", lambda i=i: (good, TableSpec.of(good.schema, f"good{i}"))) for i in range(3)],
    ]
    started = time.time()
    rows = table_results(spark, found, tokenizer, EstimateConfig(parallel=2, time_limit=20)).collect()
    assert [r.status for r in rows] == ["error", "error", "completed", "completed", "completed"]
    assert all("within 20 seconds" in r.error_message for r in rows[:2]) and time.time() - started < 150
    assert len({r.token_count for r in rows[2:]}) == 1 and rows[2].row_count == 2
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []


def test_tables_run_in_pools_of_their_own(spark, tokenizer):
    seen = []

    def load(name):
        seen.append((name, spark.sparkContext.getLocalProperty("spark.scheduler.pool"), len(spark.sparkContext.getJobTags())))
        frame = spark.createDataFrame([("x",)], "s string")
        return frame, TableSpec.of(frame.schema, name)

    found = [TableSource("public", f"t{i}", lambda i=i: load(f"t{i}")) for i in range(5)]
    assert table_results(spark, found, tokenizer, EstimateConfig(parallel=2)).count() == 5
    assert {p for _, p, _ in seen} <= {"inktally-0", "inktally-1"} and all(n == 1 for _, _, n in seen)
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


class Watched(Tokenizer):
    """Counts how often the tokenizer library is asked for."""

    asked = 0

    def counter(self, spark):
        Watched.asked += 1
        return super().counter(spark)


def test_pieces_are_learned_once(spark, data, tmp_path, tokenizer):
    used = Watched(tokenizer.pattern, tokenizer.ranks)
    read = tables(spark, data, ("documents", "nation", "labels"))
    want = sorted(map(tuple, estimate_tables(read, tokenizer).collect()))
    dictionary = PieceDictionary(spark, str(tmp_path / "pieces"), used, buckets=3)
    first, learned = estimate_with_dictionary(read, dictionary)
    assert learned > 100 and sorted(map(tuple, first.collect())) == want and Watched.asked == 1
    spark.sql(f"drop table {dictionary.name}")  # as in a new session, whose catalog is empty
    again = PieceDictionary(spark, str(tmp_path / "pieces"), used, buckets=8)
    assert again.buckets == 3
    second, learned = estimate_with_dictionary(read, again)
    assert learned == 0 and Watched.asked == 1 and sorted(map(tuple, second.collect())) == want
    # Two estimates that learn the same piece at a time count it once.
    again._append(spark.createDataFrame([("hello", 1)], "piece string, length bigint"))
    assert again.lengths().where("piece = 'hello'").count() == 1


def _below_exchanges(plan):
    """What each side of a join shuffles, as text."""
    found, todo = [], [(plan, False)]
    while todo:
        node, joined = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if joined and "Exchange" in node.nodeName():
            found.append(node.toString())
            continue
        children = node.children()
        todo += [(children.apply(i), joined or "Join" in node.nodeName()) for i in range(children.size())]
    return found


def test_the_dictionary_is_not_shuffled(spark, tmp_path, tokenizer):
    frame = spark.createDataFrame([("a b c zzzqqqx",)], "s string")
    spec = TableSpec.of(frame.schema, "t")
    dictionary = PieceDictionary(spark, str(tmp_path / "pieces"), tokenizer, buckets=3)
    counts = piece_counts(page_texts(frame, spec), tokenizer)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(Exception, match="not in the dictionary"):
            dictionary.tokens(counts).collect()
        assert dictionary.learn(counts) > 0
        found = dictionary.tokens(counts)
        shuffled = _below_exchanges(found._jdf.queryExecution().executedPlan())
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, piece_tokens(counts, tokenizer).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffled and not any("inktally_pieces" in side for side in shuffled)
