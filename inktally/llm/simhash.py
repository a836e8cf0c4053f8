"""Near-duplicates by SimHash: fingerprints, a binary trie self-join, and connected components.

The trie's upper part is a table of nodes. Pairs of existing nodes whose prefixes differ in no more bits
than the budget are listed by flipping bits of the prefix; each pair of their subtries is one group. In a
group, both subtries are walked together bit by bit: a pair of nodes goes on with its four pairs of children,
a differing bit costs one, and pairs over the budget or without rows are pruned. Nodes with many fingerprints
are cut into chunks, so a group's size is bounded whatever the fingerprints are.

Defined results: a null or empty text has fingerprint zero; repeated rows are returned as often as given;
a null doc_id is never a component's id unless all of its documents have none, then the id is null;
no rows give no rows. Extra columns pass through; of the columns named like a result, the result stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inktally.llm.common import pieces, stored, whole_row, with_results
from inktally.llm.graph import components

BITS = 64
#: Hashes whose bits are summed at once, and pairs of trie nodes that go on at once.
BLOCK, STATES = 1 << 16, 1 << 16


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Hashes of all word shingles; of a text with fewer words, that of its words."""
    words = (text or b"").lower().split()  # on bytes, both know ASCII only: A-Z, and 0x20 with 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    spans = zip(starts, ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(starts))


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles."""
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = [fingerprint(t, shingle, seed) for t in part.column(1).cast(pa.binary()).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def close_pairs(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of two sorted arrays (or of one with itself) that differ in at most ``budget`` bits."""
    alone = right is None
    right = left if alone else right
    state = np.array([[0], [len(left)], [0], [len(right)], [budget]], np.int64)
    out_left, out_right = [], []

    def settle(small: np.ndarray) -> None:
        """Compares what is left of small node pairs directly."""
        wide = small[3] - small[2]
        each = (small[1] - small[0]) * wide
        which = np.repeat(np.arange(small.shape[1]), each)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        i, j = small[0][which] + nth // wide[which], small[2][which] + nth % wide[which]
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if alone:
            near &= i < j
        out_left.append(i[near])
        out_right.append(j[near])

    def ones_of(values: np.ndarray, bit: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)

    ones, todo = {}, [(BITS - 1, state)]
    while todo:  # in depth, so that few node pairs are held at a time
        bit, state = todo.pop()
        if state.shape[1] > STATES:
            todo += [(bit, state[:, at : at + STATES]) for at in range(0, state.shape[1], STATES)]
            continue
        small = (state[1] - state[0]) * (state[3] - state[2]) <= (16 if bit >= 0 else np.inf)  # at last, equal values only
        if small.any():
            settle(state[:, small])
            state = state[:, ~small]
        if not state.shape[1]:
            continue
        if bit not in ones:
            ones[bit] = (of_left := ones_of(left, bit)), of_left if alone else ones_of(right, bit)
        ones_l, ones_r = ones[bit]
        lo, hi, lo2, hi2, left_over = state
        mid, mid2 = hi - (ones_l[hi] - ones_l[lo]), hi2 - (ones_r[hi2] - ones_r[lo2])
        crossed = [(lo, mid, mid2, hi2, left_over - 1)]
        mirrored = alone & (lo == lo2) & (hi == hi2)  # of a node with itself, one of the two crossings is enough
        crossed.append((mid, np.where(mirrored, mid, hi), lo2, mid2, left_over - 1))
        children = [(lo, mid, lo2, mid2, left_over), (mid, hi, mid2, hi2, left_over), *crossed]
        state = np.concatenate([np.array(c) for c in children], axis=1)
        todo.append((bit - 1, state[:, (state[4] >= 0) & (state[1] > state[0]) & (state[3] > state[2])]))
    return np.concatenate([*out_left, np.empty(0, np.int64)]), np.concatenate([*out_right, np.empty(0, np.int64)])


def _even_bits(values: DataFrame, wanted: int) -> list[int]:
    """The bits that halve the fingerprints best, so that the upper trie's nodes are about equal."""
    sums = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(str(b)) for b in range(BITS)]
    row = values.agg(F.count("*").alias("n"), *sums).first()
    return sorted(range(BITS), key=lambda b: (abs(2 * (row[str(b)] or 0) - row["n"]), b))[:wanted]


def links(values: DataFrame, budget: int = 2, leaf: int = 4096) -> DataFrame:
    """Pairs (a, b) of different values of the distinct column ``fp`` with at most ``budget`` differing bits."""
    total = values.count()
    depth = min(24, max(0, (max(total, 1) // leaf).bit_length()))
    bits = _even_bits(values, depth)
    parts = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), i) for i, b in enumerate(bits)]
    node = F.lit(0).cast("long")
    for part in parts:
        node = node.bitwiseOR(part)
    placed = values.select("fp", node.alias("u"))
    nodes = placed.groupBy("u").agg(F.ceil(F.count("*") / F.lit(4 * leaf)).cast("int").alias("chunks"))
    flips = [sum(1 << i for i in c) for n in range(min(budget, depth) + 1) for c in combinations(range(depth), n)]
    pairs = nodes.withColumn("v", F.explode(F.array(*[F.col("u").bitwiseXOR(F.lit(m).cast("long")) for m in flips])))
    pairs = pairs.join(nodes.select(F.col("u").alias("v"), F.col("chunks").alias("other")), "v")
    sides = placed.join(pairs, "u").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    sides = sides.withColumn("its", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    first = (F.col("u") < F.col("v")) | (F.col("u") == F.col("v")) & (F.col("own") <= F.col("its"))
    ordered = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("u", "v"), ("v", "u"), ("own", "its"), ("its", "own"))]
    dealt = sides.select("fp", first.alias("first"), *[c.alias(k) for c, k in zip(ordered, ("n1", "n2", "c1", "c2"), strict=True)])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        here = group["first"].to_numpy()
        fps = group["fp"].to_numpy().view(np.uint64)
        left, right = np.sort(fps[here]), np.sort(fps[~here])
        own = group["n1"].iat[0] == group["n2"].iat[0] and group["c1"].iat[0] == group["c2"].iat[0]
        i, j = close_pairs(left, None if own else right, budget)
        right = left if own else right
        return pd.DataFrame({"a": left[i].view(np.int64), "b": right[j].view(np.int64)})

    return dealt.groupBy("n1", "n2", "c1", "c2").applyInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    marked = stored(fingerprints(docs, shingle, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    members = components(links(classes.select("fp"), budget), "a", "b")
    rooted = classes.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, whatever doc_ids repeat or are missing.

    That of its smallest doc_id stays, null last, and of equal doc_ids one whose text has the smallest hash. Copies are
    folded in each task before they are shuffled, and whole rows are shuffled once, by their text.
    """
    key = F.xxhash64("text")
    linked = near_duplicates(docs.select(key.alias("doc_id"), "text"), budget, shingle, seed)
    roots = linked.groupBy(F.col("doc_id").alias("node")).agg(F.min("component_id").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").cast("long").alias("doc_id"))
    nodes = docs.groupBy(key.alias("node")).agg(F.min(order).alias("first"))
    lone = nodes.join(roots, "node").groupBy("root").agg(F.min(F.struct("first", "node")).alias("lone"))
    rows = whole_row(docs, key.alias("node"), order.alias("order")).groupBy("node").agg(F.min_by("given", "order").alias("given"))
    return with_results(rows.join(lone.select("lone.node"), "node", "left_semi"), docs.columns)
