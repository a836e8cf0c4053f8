"""Shards, top-k, repeated passages and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from inktally.llm import sharding, simhash, suffix_dedup, topk
from tests.llm.helpers import EDGES, prose, table


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rng = random.Random(3)
    rows = [(rng.randrange(-50, 500), prose(i, rng.randint(1, 60))) for i in range(300)] + EDGES + [(77, "same")] * 90
    found = sharding.sharded(table(spark, rows)).collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    order = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot))
    assert [r.shard for r in order] == sorted(r.shard for r in found)  # contiguous
    at = 0
    for r in order:
        assert r.shard == (2 * at + r.size) * 24 // (2 * total)
        at += r.size
    for shard in range(24):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    want = sorted([(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows], key=repr)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in found], key=repr) == want
    assert sharding.sharded(table(spark, [])).count() == 0


def test_shards_of_hot_ids(spark):
    """20,000 equal rows, 20,000 rows of one id and 20,000 without an id; ranges are cut inside of them."""
    base = spark.range(20_000).selectExpr("cast(id as string) as n")
    docs = base.selectExpr("1L as doc_id", "'same' as text").union(base.selectExpr("2L", "n")).union(base.selectExpr("cast(null as long)", "n"))
    found = sharding.sharded(docs.repartition(4)).groupBy("shard").agg({"slot": "max", "size": "sum", "*": "count"}).collect()
    assert len(found) == 24 and all(r["max(slot)"] + 1 == r["count(1)"] for r in found)
    sizes = [r["sum(size)"] for r in found]
    assert max(sizes) - min(sizes) <= 2 * 13 and sum(r["count(1)"] for r in found) == 60_000


def _best(vectors, k):
    out = []
    for q, a in vectors.items():
        if q % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q)[:k]
        out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 4096])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(0, 400, 5)]
    rows += [(i, rows[i % 7][1]) for i in range(1001, 1040)]  # ties
    broken = [(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf"), 1.0]), (None, [1.0]), (1001, rows[-39][1])]
    short = [(50_000, [0.5]), (6, [])]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows + broken + short], "vec_id long, embedding array<float>, shard int, asks string")
    whole = topk.whole_vectors(frame)
    import math

    as_float = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows + short}
    found = topk.top_k(whole, whole["vec_id"] % 50 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == _best(as_float, 5)
    nothing = topk.whole_vectors(frame.limit(0))
    assert topk.top_k(nothing, nothing["vec_id"] % 50 == 0, 5).count() == 0


def _brute_repeats(rows, length):
    """By windows, documents in order; equal rows count as one."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (key[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, kept)
    return sorted([(r[0], *out[r]) for r in rows], key=repr)


@pytest.mark.parametrize("length,limit", [(100, 1 << 15), (100, 1), (20, 3)])
def test_repeats(spark, length, limit):
    rng = random.Random(8)
    passages = [prose(s, 40, 4000) for s in range(6)]
    rows = [(1, "ab" * 400), (2, "x" * 99), (3, "x" * 100), (4, "y" + "x" * 100), (5, None), (6, ""), (7, "é" * 120), (7, "é" * 120)]
    for i in range(40):
        body = prose(50 + i, 60, 4000)
        cut = rng.randrange(len(body))
        rows.append((10 + i, body[:cut] + rng.choice(passages)[rng.randrange(60) :] + body[cut:]))
    rows += [(100 + i, rows[20 + i][1]) for i in range(5)] + [(200, rows[25][1][:-3] + "zzz"), (None, rows[9][1])]
    found = suffix_dedup.without_repeats(table(spark, rows), length, limit, group_bytes=4000).collect()
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(mine, key=repr) == _brute_repeats(rows, length)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans
    assert suffix_dedup.without_repeats(table(spark, [])).count() == 0


def test_long_texts_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    long = prose(1, 900, 5000)
    rows = [(1, long), (2, "q" + long), (3, prose(2, 300, 5000) + long[500:2500])]
    found = suffix_dedup.without_repeats(table(spark, rows)).collect()
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(mine, key=repr) == _brute_repeats(rows, 100)


def test_run_index():
    text = np.array(list(b"abracadabra" * 20) + [1000])
    order = suffix_dedup.suffix_order(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = suffix_dedup.RunIndex(text)
    assert index.runs < len(text) / 4
    before, shared = index.statistics(np.arange(len(text)))
    for k in range(1, len(text)):
        i, j = order[k], order[k - 1]
        assert before[i] == j and (text[i : i + shared[i]] == text[j : j + shared[i]]).all()


def test_suffixes_told_apart_are_not_sorted_again(monkeypatch):
    """A long passage that comes twice costs no more sorting of the rest of the text."""
    rng = np.random.default_rng(1)
    text = rng.integers(0, 200, 20_000)
    text[15_000:15_400] = text[3_000:3_400]
    worked, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *more: worked.append(len(a)) or sort(a, *more))
    order = suffix_dedup.suffix_order(text)
    assert sum(worked) < 1.5 * len(text)
    monkeypatch.undo()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i : i + 500].tolist())
    for odd in ([], [5], [7, 7, 7, 7], [1 << 40, -3, 1 << 40, -3, 1 << 40]):
        assert suffix_dedup.suffix_order(np.array(odd, np.int64)).tolist() == sorted(range(len(odd)), key=lambda i: odd[i:])


def test_pipeline(spark, tmp_path):
    """Each stage's decision is seen, and clean documents come through."""
    clean = [(i, prose(i, 150, 3000), "aa") for i in range(20)]
    item = prose(999, 30)
    # Lines that differ only now and then keep a near copy of a document.
    changed = clean[0][1].replace("\n", " . ").replace(" . ", "\n", 1)
    rows = clean + [
        (100, None, "aa"), (101, "", "aa"), (102, "123 !?", "aa"),
        (103, prose(50, 60) + item + prose(51, 60), "aa"),
        (104, changed, "aa"), (105, clean[1][1] + "\n" + prose(70, 150, 3000), "aa"), (None, prose(80, 90), None),
    ]
    table(spark, rows).drop("hits").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in found}
    assert {i for i, _, _ in clean} | {105, None} <= ids and not ids & {100, 101, 102, 103}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_drops_near_copies(spark, tmp_path):
    """A copy within two bits over three-word shingles goes, one beyond them stays, as does any other text."""
    body = prose(300, 900, 3000).replace("\n", " ")
    words = body.split()
    near = next(
        t for i in range(20, 800, 7)
        if 0 < (simhash.fingerprint(body.encode()) ^ simhash.fingerprint((t := " ".join([*words[:i], "other", *words[i + 1 :]])).encode())).bit_count() <= 2
    )
    far = " ".join([*words[:100], *prose(301, 200, 3000).split()])
    rows = [(5, body, "aa"), (6, near, "aa"), (7, far, "aa"), (None, prose(302, 200, 3000), "aa"), (None, prose(303, 200, 3000), "aa")]
    docs = table(spark, rows).drop("hits")
    kept = corpus_pipeline.simhash_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [5, 7, None, None]


def test_texts_of_one_doc_id_are_told_apart(spark):
    """Two texts whose hashes agree in 24 bits, under one doc_id; and ids beyond 2**62 beside rows without one."""
    import xxhash

    def mark(text):
        return xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFF

    passage = prose(400, 80, 4000)[:300]
    others = {mark(t): t for t in (prose(9000 + i, 60, 4000)[:300] for i in range(400))}
    one = next(t for j in range(1_000_000) if mark(t := passage + f"{j:09d}") in others)
    rows = [(1, passage), (2, one), (2, others[mark(one)]), (2**62 + 9, passage + "end"), (2**63 - 2, "q" * 150), (None, "q" * 150 + "r")]
    found = suffix_dedup.without_repeats(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found], key=repr) == _brute_repeats(rows, 100)
