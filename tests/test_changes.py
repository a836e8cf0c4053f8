"""Changes between two loads."""

import pytest

from inktally.operators.changes import LoadedVersion, change_counts, changes, folded
from inktally.operators.documents import documents
from inktally.spec import TableSpec


def load(spark, rows, pk=("k",)):
    frame = spark.createDataFrame(rows, "k int, v string").repartition(3)
    return documents(frame, TableSpec.of(frame.schema, "t", pk=pk))


def test_changes_of_a_table_with_a_key(spark, tmp_path):
    before = LoadedVersion(spark, str(tmp_path / "load"), 3).store(load(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None), (None, "n"), (5, "x"), (5, "y")]))
    new = load(spark, [(1, "a"), (2, "B"), (4, ""), (6, "f"), (None, "n"), (5, "y"), (5, "z")])
    found = changes(before, new)
    kinds = sorted((r.change, r.copies_before, r.copies_after) for r in found.collect())
    assert kinds == [("added", 0, 1), ("changed", 1, 1), ("changed", 1, 1), ("changed", 2, 2), ("removed", 1, 0)]
    (row,) = change_counts(found).collect()
    assert (row.added, row.removed, row.changed) == (1, 1, 4)
    assert changes(before, load(spark, [(5, "y"), (5, "x"), (None, "n"), (4, None), (3, "c"), (2, "b"), (1, "a")])).count() == 0
    again = LoadedVersion(spark, str(tmp_path / "load"), 9)
    assert again.buckets == 3 and again.rows.count() == 6


def test_rows_without_a_key_are_counted(spark, tmp_path):
    before = LoadedVersion(spark, str(tmp_path / "load"), 2).store(load(spark, [(1, "a")] * 3 + [(2, "b")] + [(3, "c")] * 2, ()))
    found = changes(before, load(spark, [(1, "a")] * 5 + [(3, "c")] * 2 + [(9, None)], ()))
    assert sorted((r.change, r.copies_before, r.copies_after) for r in found.collect()) == [("added", 0, 1), ("added", 3, 5), ("removed", 1, 0)]
    (row,) = change_counts(found).collect()
    assert (row.added, row.removed, row.changed) == (3, 1, 0)
    assert changes(before, load(spark, [], ())).count() == 3 and folded(load(spark, [], ())).count() == 0
    empty = LoadedVersion(spark, str(tmp_path / "empty"), 2).store(load(spark, [], ()))
    assert {r.change for r in changes(empty, load(spark, [(1, "a")], ())).collect()} == {"added"}


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    before = LoadedVersion(spark, str(tmp_path / "load"), 8).store(load(spark, [(1, "a")]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes(before, load(spark, [(2, "a")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "inktally_load" in x)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert not any("Exchange" in x for x in lines[join:scan])


def test_a_load_of_fewer_buckets_than_partitions_is_not_shuffled_again(spark, tmp_path):
    """It is kept in as many parts, a file each, of hashes as bytes; the new side is shuffled once."""
    rows = [(i, f"v{i}") for i in range(3000)]
    kept, partitions, threshold = {}, "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"
    for pk in (("k",), ()):
        before = LoadedVersion(spark, str(tmp_path / f"load{len(pk)}"), 3).store(load(spark, rows, pk))
        assert spark.conf.get(partitions) == "4" and before.buckets == 3 and before.rows.count() == 3000
        files = [p for p in (tmp_path / f"load{len(pk)}").rglob("*.parquet")]
        assert len(files) <= 4
        kept[pk] = sum(p.stat().st_size for p in files) / 3000
        old = spark.conf.get(threshold)
        spark.conf.set(threshold, "-1")
        try:
            found = changes(before, load(spark, rows[:2990] + [(2990, "w")], pk))
            plan = found._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set(threshold, old)
        lines = plan.splitlines()
        scan = next(i for i, x in enumerate(lines) if "inktally_load" in x)
        assert not any("Exchange" in x for x in lines[next(i for i, x in enumerate(lines) if "Join" in x) : scan])
        assert sum("Exchange hashpartitioning" in x for x in lines[scan:]) == 1
        (row,) = change_counts(found).collect()
        assert (row.added, row.removed, row.changed) == ((0, 9, 1) if pk else (1, 10, 0))
    # Two hashes of 32 bytes of a document with a key, one of a row without.
    assert kept[("k",)] < 80 and kept[()] < 48
    assert {len(r.doc_id) for r in found.collect()} == {len(r.row_hash) for r in found.collect()} == {64}
    (tmp_path / "early" / "buckets-3").mkdir(parents=True)
    with pytest.raises(ValueError, match="earlier form"):
        LoadedVersion(spark, str(tmp_path / "early"))


def test_counts_of_changes_make_no_text_of_hashes(spark, tmp_path):
    """Counting needs neither doc_id nor row_hash as text; both kinds of tables, rows that share a key and rows that repeat."""
    old = [(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d")]
    new = [(1, "b"), (1, "a"), (2, "c"), (4, "e"), (4, "e"), (3, "D")]
    for pk, want in ((("k",), (2, 1, 1)), ((), (3, 2, 0))):
        before = LoadedVersion(spark, str(tmp_path / f"load{len(pk)}"), 2).store(load(spark, old, pk))
        counts = change_counts(changes(before, load(spark, new, pk)))
        (row,) = counts.collect()
        assert (row.added, row.removed, row.changed) == want
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "lower(hex(" not in plan and [kind for _, kind in before.rows.dtypes].count("binary") == 2
