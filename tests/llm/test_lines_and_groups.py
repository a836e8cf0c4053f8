"""Line dedup, SimHash and the graph against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inktally.llm import line_dedup, simhash
from inktally.llm.graph import components
from tests.llm.helpers import EDGES, prose, table

BLANK = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def _brute_lines(rows, least=10):
    owners = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= least:
                owners.setdefault(_key(line), set()).add(2**63 - 1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = 2**63 - 1 if doc is None else doc
        left = [x for x in lines if len(owners.get(_key(x), ())) < 2 or min(owners[_key(x)]) == me]
        out.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rng = random.Random(batches)
    shared = [prose(s, 11).replace("\n", " ") for s in range(12)]
    rows = [(i, "\n".join(rng.choice(shared + [f"only in {i}, {j}"]) for j in range(rng.randint(1, 9)))) for i in range(60)]
    rows += EDGES
    found = line_dedup.without_repeated_lines(table(spark, rows), batches=batches, fanout=fanout)
    mine = [(r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in found.collect()]
    assert sorted(mine, key=repr) == _brute_lines(rows)
    assert found.columns.count("kept") == 1 and "given" in found.columns


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_are_not_shuffled(spark, fanout, monkeypatch):
    """A batch is dealt by hash once; runs are joined and compacted in the buckets they were written in."""
    plans = []
    written = line_dedup.bucketed
    monkeypatch.setattr(
        line_dedup, "bucketed", lambda rows, label, keys: plans.append((label, rows._jdf.queryExecution().toString())) or written(rows, label, keys)
    )
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(i, f"a line of many, number {i % 50}\nand one of its own, number {i}") for i in range(200)]
    found = line_dedup.without_repeated_lines(table(spark, rows), batches=7, fanout=fanout)
    assert sorted((r.doc_id, r.n_dropped) for r in found.collect()) == [(i, int(i >= 50)) for i in range(200)]
    assert [label for label, _ in plans].count("run") >= 2
    for label, plan in plans:
        physical = plan[plan.index("== Physical Plan") :]
        assert physical.count("Exchange hashpartitioning") == (1 if label == "keys" else 0)
        assert "BroadcastHashJoin" not in physical
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lines_of_an_empty_table(spark):
    assert line_dedup.without_repeated_lines(table(spark, [])).count() == 0


def test_a_very_long_text(spark):
    text = "\n".join(f"line number {i % 30000}" for i in range(60000))
    rows = [(1, text), (2, text)]
    found = {r.doc_id: (r.kept, r.n_dropped) for r in line_dedup.without_repeated_lines(table(spark, rows)).collect()}
    assert found == {1: (text, 0), 2: ("", 60000)}


def _brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in BLANK}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*[t for _, t in EDGES], *[prose(s, n) for s, n in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 500))]]:
        assert simhash.fingerprint(None if text is None else text.encode()) == _brute_fingerprint(text)


@pytest.mark.parametrize("alone", [True, False])
def test_trie_walk(alone):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (30, 2))]
    values = np.unique(np.array([*near, *centres, 0, 2**64 - 1], np.uint64))
    left, right = (values, values) if alone else (values[::2], values[1::2])
    want = {
        (int(a), int(b)) for i, a in enumerate(left) for j, b in enumerate(right)
        if (not alone or i < j) and int(a ^ b).bit_count() <= 2
    }
    i, j = simhash.close_pairs(left, None if alone else right, 2)
    assert {(int(a), int(b)) for a, b in zip(left[i], right[j])} == want and len(i) == len(want)


def test_links_of_many_nodes(spark):
    """With leaves of a few values, the upper trie and its chunks do most of the work."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0] * 3
    values = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(12)} | set(centres)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    mine = {frozenset((r.a, r.b)) for r in simhash.links(frame, 2, leaf=2).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert mine == want and want


def _brute_components(rows):
    prints = [_brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for (doc, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append(doc)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [smallest[r] for r in root]


def test_near_duplicates(spark):
    rows = list(EDGES)
    for s in range(8):
        base = prose(s, 400)
        words = base.split(" ")
        rows += [(100 + 10 * s, base), (101 + 10 * s, " ".join([*words[:50], "changed", *words[51:]])), (99 - s, base.upper())]
    found = simhash.near_duplicates(table(spark, rows)).collect()
    want = sorted(zip([r[0] for r in rows], _brute_components(rows), strict=True), key=repr)
    assert sorted([(r.doc_id, r.component_id) for r in found], key=repr) == want
    kept = simhash.without_near_duplicates(table(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    roots = {c for _, c in want}
    assert sorted(ids, key=repr) == sorted(roots, key=repr)
    assert kept.columns == table(spark, []).columns
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.without_near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    links += [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    assert {r.node: r.root for r in found} == {n: find(n) for n in root} and len(found) == len(root)
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_line_query_digest(spark, tmp_path):
    from inktally.llm import queries

    table(spark, EDGES).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op6_line_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in _brute_lines(EDGES)]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows], key=repr) == sorted(want, key=repr)
    prints = queries.op8_simhash(spark, str(tmp_path)).where(F.col("doc_id") == 5).first()
    assert prints.fingerprint == f"{_brute_fingerprint(EDGES[7][1]):016x}"


def test_rows_without_or_with_repeated_ids_stay(spark):
    """One row of each component, not one of each doc_id."""
    base = prose(71, 300)
    near = base.replace(" ", "  ", 1)
    rows = [(None, prose(s, 200)) for s in range(60, 66)] + [(7, prose(s, 200)) for s in range(66, 69)]
    rows += [(3, base), (8, near), (8, prose(72, 200)), (None, near.upper())]
    want = sorted([t for i, t in rows if t not in (near, near.upper())])
    kept = simhash.without_near_duplicates(table(spark, rows))
    assert sorted(r.text for r in kept.collect()) == want and kept.columns == table(spark, []).columns


def test_many_copies_are_folded_before_they_are_shuffled(spark):
    """20,000 equal rows, without an id and with one, leave one row; each task hands on a row of each text."""
    base, other = prose(5, 60), prose(6, 60)
    one = table(spark, [(None, base), (4, base), (9, other)])
    many = one.crossJoin(spark.range(20_000, numPartitions=8).select(F.col("id").alias("nth"))).drop("nth").repartition(8)
    kept = simhash.without_near_duplicates(many)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(4, base), (9, other)]


def test_scratch_is_of_the_application_and_can_be_cleared(spark, tmp_path):
    from inktally.llm.common import shared_folder, stored
    from inktally.sources.scratch import clear_scratch

    frame = stored(spark.range(3), "try")
    place = frame.inputFiles()[0]
    assert shared_folder(spark) in place and spark.sparkContext.applicationId in place
    clear_scratch(spark)
    import os

    assert not os.path.exists(place.removeprefix("file://"))
