import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inktally.operators import progress
from inktally.sources import scratch
from inktally.sources.price_files import fallback_prices
from inktally.operators.prices import costs_in_force, prices_in_force
from inktally.streaming.progress import LOG, current_costs, current_lines, current_snapshots, follow_progress

START = datetime(2024, 1, 1)


def log(spark, rows):
    made = [
        (run, "s", t, n, k, "completed" if e is None else "error", e, START + timedelta(seconds=at))
        for run, t, n, k, e, at in rows
    ]
    return spark.createDataFrame(made, LOG)


THREE = [(1, "a", 10, 100, None, 10), (1, "b", 0, 0, "no such table", 20), (1, "c", 5, 50, None, 31)]


def runs(spark, *pairs):
    return spark.createDataFrame([(r, START, t) for r, t in pairs], "run_id bigint, started_at timestamp_ntz, total bigint")


def test_running_progress(spark):
    rows = progress.running_progress(log(spark, THREE), runs(spark, (1, 3))).orderBy("completed").collect()
    assert [r.percent_complete for r in rows] == [33, 67, 100]
    assert [r.errors for r in rows] == [0, 1, 1]
    assert [r.total_tokens for r in rows] == [100, 100, 150]
    assert [(r.eta_seconds, r.eta) for r in rows] == [(20, "00:20"), (10, "00:10"), (None, None)]
    assert [r.elapsed_seconds for r in rows] == [10, 20, 31]


def test_snapshot(spark):
    found = progress.progress_snapshot(log(spark, THREE), runs(spark, (1, 8), (2, 0))).orderBy("run_id").collect()
    assert (found[0].completed, found[0].percent_complete, found[0].total_rows) == (3, 38, 15)
    assert (found[1].completed, found[1].percent_complete, found[1].elapsed_seconds) == (0, 0, 0)


@pytest.mark.parametrize("done,total,expected", [(1, 8, 13), (0, 0, 0), (1, 3, 33), (2, 3, 67), (0, 5, 0)])
def test_percent(spark, done, total, expected):
    frame = spark.createDataFrame([(done, total)], "d bigint, t bigint")
    assert frame.select(progress.percent(F.col("d"), F.col("t")).alias("p")).first().p == expected


def test_clock(spark):
    frame = spark.createDataFrame([(0,), (61,), (6000,)], "s bigint").coalesce(1)
    assert [r.t for r in frame.select(progress.clock(F.col("s")).alias("t")).collect()] == ["00:00", "01:01", "100:00"]


def test_changed_snapshots_keep_one_of_equals(spark):
    rows = [(1, t, 0, k, None, at) for t, k, at in (("a", 1, 1), ("b", 1, 2), ("c", 2, 3), ("d", 1, 4))]
    kept = progress.changed_snapshots(log(spark, rows), ["token_count"], ["completed_at", "table"]).collect()
    assert sorted(r.table for r in kept) == ["a", "c", "d"]


def snapshot_files(path):
    return [json.loads(line) for f in path.glob("*.json") for line in f.read_text().splitlines()]


def read(path, part):
    current = (path / "CURRENT").read_text().strip()
    return snapshot_files(path / "versions" / current / part)


def test_written_progress(spark, tmp_path):
    for _ in range(2):
        folder = progress.write_progress(log(spark, THREE), runs(spark, (1, 3), (2, 5)), fallback_prices(spark), str(tmp_path), [1])
    assert folder == progress.current_version(spark, str(tmp_path)) and len(list((tmp_path / "versions").iterdir())) == 2
    found = {r["runId"]: r for r in read(tmp_path, "snapshots")}
    assert found[1]["startTime"] == "2024-01-01T00:00:00.000Z" and found[1]["elapsedSeconds"] == 31
    assert found[1]["progress"] == {"completed": 3, "total": 3, "errors": 1, "percentComplete": 100}
    assert found[1]["totals"] == {"totalTokens": 150, "totalRows": 15} and found[1]["status"] == "completed"
    assert found[2]["progress"]["completed"] == 0 and found[2]["status"] == "in_progress"
    lines = read(tmp_path, "tables")
    assert sorted((t["runId"], t["table"]) for t in lines) == [(1, "a"), (1, "b"), (1, "c")]
    assert [t.get("errorMessage") for t in lines if t["table"] == "b"] == ["no such table"]
    costs = read(tmp_path, "costs")
    assert {c["model"]: c["cost"] for c in costs}["voyage-3"] == 150 / 1e6 * 0.06 and {c["runId"] for c in costs} == {1}


def test_costs_of_no_run(spark):
    snapshots = progress.progress_snapshot(log(spark, THREE), runs(spark, (1, 3)))
    assert progress.progress_costs(snapshots, fallback_prices(spark), []).count() == 0
    assert progress.progress_costs(snapshots, fallback_prices(spark), [9]).count() == 0


def test_costs_of_all_runs(spark, monkeypatch):
    """Models in one block and in several, broadcast and not."""
    from inktally.operators import prices

    totals = spark.createDataFrame([(r, 1000 * r) for r in range(1, 30)], "run_id bigint, total_tokens bigint")
    listed = spark.createDataFrame([(i, "p", f"m{i % 37}", float(i)) for i in range(50)], "ordinal int, provider string, model string, price_per_million double")
    last = {f"m{i % 37}": float(i) for i in range(50)}
    want = sorted((r, m, r * 1000 / 1e6 * p) for r in range(1, 30) for m, p in last.items())
    for block, most in ((1000, 100), (5, 100), (5, 3)):
        monkeypatch.setattr(prices, "BLOCK", block)
        monkeypatch.setattr(prices, "BROADCAST", most)
        found = progress.progress_costs(totals, listed)
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert progress.progress_costs(totals, listed, [3]).count() == 37
    assert progress.progress_costs(totals, listed.limit(0)).count() == 0


def test_old_versions_expire(spark, tmp_path):
    for _ in range(4):
        last = progress.write_progress(log(spark, THREE), runs(spark, (1, 3)), fallback_prices(spark), str(tmp_path), keep=2)
    left = sorted(p.name for p in (tmp_path / "versions").iterdir())
    assert len(left) == 2 and last.endswith(left[-1]) and len(read(tmp_path, "costs")) == 11


def test_prices_in_force(spark):
    """Before the first list, at its very time, within and beyond 24 hours, and between lists, in ranges of their own."""
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    snapshots = spark.createDataFrame([(day(1),), (day(1),), (day(3),), (day(3, 5),)], "fetched_at timestamp_ntz")
    asked = [day(0), day(1), day(1, 23), day(2), day(2, 1), day(3, 4), day(3, 5), day(4, 4), day(9)]
    want = [None, day(1), day(1), None, None, day(3), day(3, 5), day(3, 5), None]
    moments = spark.createDataFrame([(i, a, "x") for i, a in enumerate(asked)], "n int, as_of timestamp_ntz, _list string").repartition(3)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = prices_in_force(moments, snapshots)
        assert [r.fetched_at for r in found.orderBy("n").collect()] == want and found.columns == [*moments.columns, "fetched_at"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prices_in_force(moments, snapshots.limit(0)).where("fetched_at is not null").count() == 0
    assert prices_in_force(moments.limit(0), snapshots).count() == 0
    runs_ = prices_in_force(moments, snapshots).withColumn("total_tokens", F.lit(2_000_000))
    entries = spark.createDataFrame(
        [(day(1), 0, "p", "a", 1.0), (day(1), 1, "p", "a", 3.0), (day(3, 5), 0, "p", "b", 5.0)],
        "fetched_at timestamp_ntz, ordinal int, provider string, model string, price_per_million double",
    )
    costs = costs_in_force(runs_, entries, fallback_prices(spark)).collect()
    # A list without entries is in force all the same.
    assert sorted((r.n, r.model, r.cost) for r in costs if r.n in (1, 2, 5, 6, 7)) == [(1, "a", 6.0), (2, "a", 6.0), (6, "b", 10.0), (7, "b", 10.0)]
    assert {r.n for r in costs if r.model == "voyage-3"} == {0, 3, 4, 8}


def test_entries_of_lists_that_were_not_in_force_are_not_shuffled(spark):
    """They go before the first exchange; entries without a list meet the runs without one, next to the fallback's."""
    day = lambda d: START + timedelta(days=d)
    dated = spark.createDataFrame([(1, day(3), 10**6), (2, day(3), 2 * 10**6), (3, None, 10**6)], "run_id int, fetched_at timestamp_ntz, total_tokens long")
    lists = [None, *map(day, range(100))]
    rows = [(at, i, "p", f"m{i % 3}", float(i)) for at in lists for i in range(4)]
    entries = spark.createDataFrame(rows, "fetched_at timestamp_ntz, ordinal int, provider string, model string, price_per_million double")
    fallback = fallback_prices(spark)
    found = costs_in_force(dated, entries, fallback)
    got = sorted((r.run_id, r.model, r.cost) for r in found.collect())
    last = {"m0": 3.0, "m1": 1.0, "m2": 2.0}
    want = [(run, m, n * p) for run, n in ((1, 1), (2, 2), (3, 1)) for m, p in last.items()]
    want += [(3, r.model, float(r.price_per_million)) for r in fallback.collect()]
    assert got == sorted(want)
    assert costs_in_force(dated.where("run_id < 3"), entries, fallback).count() == 6
    assert costs_in_force(dated.limit(0), entries, fallback).count() == 0
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert any("Aggregate" in x for x in lines[:semi]) and "rightHint=(strategy=broadcast)" in lines[semi]


def batches(out):
    """Rows written per batch, and lines in all."""
    found = {p.name: len(snapshot_files(p / "snapshots")) for p in sorted((out / "batches").iterdir())}
    return list(found.values()), len(snapshot_files(out / "tables")) if (out / "tables").exists() else 0


def test_stream_writes_what_changed(spark, tmp_path):
    """Each batch writes the runs it changed; sums go on after a restart; costs of all runs belong to their newest document."""
    results = [(1, "a", 10, 100, None, 10), (2, "a", 1, 7, None, 15), (1, "b", 0, 0, "no such table", 20), (1, "c", 5, 50, None, 31), (2, "b", 2, 5, None, 40)]
    (tmp_path / "log").mkdir()
    out, all_runs = tmp_path / "out", runs(spark, (1, 3), (2, 3), (3, 1))
    arguments = (spark, str(tmp_path / "log"), all_runs, fallback_prices(spark), str(out), str(tmp_path / "state"))
    for rows, written, lines in (([], [3], 0), (results[:2], [3, 2], 2), (results[2:4], [3, 2, 1], 4), (results[4:], [3, 2, 1, 1], 5)):
        if rows:
            log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        following = follow_progress(*arguments, available_now=True)
        assert following.awaitTermination(120)
        assert batches(out) == (written, lines)
    found = {r.runId: r for r in current_snapshots(spark, str(out)).collect()}
    assert {k: (r.progress.completed, r.progress.errors, r.totals.totalTokens, r.status) for k, r in found.items()} == {
        1: (3, 1, 150, "completed"), 2: (2, 0, 12, "in_progress"), 3: (0, 0, 0, "in_progress"),
    }
    costs = current_costs(spark, str(out)).collect()
    assert len(costs) == 33 and {c.runId: c.cost for c in costs if c.model == "voyage-3"} == {1: 150 / 1e6 * 0.06, 2: 12 / 1e6 * 0.06, 3: 0.0}
    assert current_lines(spark, str(out)).count() == 5


def test_many_batches_become_one(spark, tmp_path):
    (tmp_path / "log").mkdir()
    out = tmp_path / "out"
    for i in range(9):
        log(spark, [(i % 3, f"t{i}", 1, 10, None, i)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    follow_progress(
        spark, str(tmp_path / "log"), runs(spark, (0, 3), (1, 3), (2, 3)), fallback_prices(spark), str(out), str(tmp_path / "state"),
        available_now=True, files_per_batch=1, most=3,
    ).awaitTermination(120)
    assert len(list((out / "batches").iterdir())) <= 6
    assert {r.runId: r.totals.totalTokens for r in current_snapshots(spark, str(out)).collect()} == {0: 30, 1: 30, 2: 30}
    assert current_costs(spark, str(out)).count() == 33 and current_lines(spark, str(out)).count() == 9


class Session:
    """What the scratch folder asks of a session."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_scratch_follows_one_rule(spark):
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_folder(Session("local[2]", None))
    with pytest.raises(ValueError, match="share"):
        scratch.scratch_folder(Session("spark://host:7077", "file:/tmp/x"))
    assert scratch.scratch_folder(Session("local[2]", "/tmp/x/")) == "/tmp/x"


def test_scratch_may_be_a_shared_mount_of_a_cluster(spark, tmp_path, monkeypatch):
    """A ``file:`` folder is not refused for its scheme: tasks write to it, and it is refused if that is not read back."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for folder, shared in ((f"file://{tmp_path}/", True), (str(tmp_path / "plain"), True), ("file:/proc/none", False)):
        monkeypatch.setattr(scratch, "SETTING", "spark.inktally.tried")
        spark.conf.set("spark.inktally.tried", folder)
        if shared:
            assert scratch.scratch_folder(spark) == folder.rstrip("/")
            made = len(list(tmp_path.rglob("shared-*")))
            assert scratch.written(spark.range(3), "kept").count() == 3
            assert len(list(tmp_path.rglob("shared-*"))) == made, "one job tells, once"
        else:
            with pytest.raises(ValueError, match="share"):
                scratch.scratch_folder(spark)
    spark.conf.unset("spark.inktally.tried")


def test_scratch_is_cleared(spark):
    made = scratch.written(spark.range(3), "kept")
    assert made.count() == 3
    files = made.inputFiles()
    scratch.clear_scratch(spark)
    assert files and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
