"""Exact k best inner products of integer vectors by MaxScore, over shards of the rows.

Rows are dealt into shards and queries into blocks; every shard meets every block once. A shard is an index by
term (a component of the vector): postings in order of impact, and the smallest and largest value. A query's
contribution of a term is counted from the worst value in the shard, so it is never negative, and has a bound.
Terms are sorted by bound. Those that could not lift a row over the k-th best score so far, all together, are
not essential. Essential postings are traversed; the rows met are probed for the other terms while what is left
of the bounds keeps them competitive. The k best of each shard are merged by query.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows
without a vec_id; of rows that share a vec_id, the smallest vector counts; a component that a shorter vector
lacks is zero; ties go to the smaller vec_id; no rows give no rows. Scores are 64-bit whole numbers and have to
fit. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block.
SHARD, BLOCK = 4096, 4096
#: Terms added between two looks at what is competitive; first postings that give a first bound, of how many terms.
STRIDE, FIRST, LEADING = 8, 16, 4


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, for vectors that take part."""
    endless = F.lit(float("inf"))
    sound = F.forall(
        "embedding",
        lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != endless), F.lit(False)),
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    some = vectors.where("vec_id is not null and embedding is not null").where(sound)
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


class Shard:
    """The rows of a shard, by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.terms = np.ascontiguousarray(self.rows.T)
        self.low, self.high = self.terms.min(axis=1, initial=0), self.terms.max(axis=1, initial=0)
        self.low, self.high = (self.terms.min(axis=1), self.terms.max(axis=1)) if len(ids) else (self.low, self.high)
        self.impact = np.argsort(self.terms, axis=1, kind="stable")

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best rows but the query's own, in order."""
        worst = np.where(query >= 0, self.low, self.high)
        bound = query * (np.where(query >= 0, self.high, self.low) - worst)
        base = int((query * worst).sum())
        terms = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])
        own = np.searchsorted(self.ids, query_id)
        own = own if own < len(self.ids) and self.ids[own] == query_id else -1

        # The first postings of the leading terms give a score that k rows reach.
        first = [self.impact[t, -FIRST:] if query[t] >= 0 else self.impact[t, :FIRST] for t in terms[:LEADING]]
        seeds = np.setdiff1d(np.concatenate(first) if first else np.empty(0, np.int64), [own])
        reached = np.iinfo(np.int64).min
        if len(seeds) >= k:
            reached = int(np.partition(self.rows[seeds] @ query, -k)[-k])

        essential = int(np.searchsorted(-(base + left), -reached, "right"))  # terms from there on fall short together
        rows = np.arange(len(self.ids))
        rows = rows[rows != own]
        score = np.full(len(rows), base, np.int64)
        for at in range(0, len(terms), STRIDE):
            some = terms[at : at + STRIDE]
            values = self.terms[some] if len(rows) == len(self.ids) else self.terms[some[:, None], rows]
            score += query[some] @ values - int((query[some] * worst[some]).sum())
            rest = left[min(at + STRIDE, len(terms))]
            if at + STRIDE >= essential and at < essential:
                met = score > base  # rows in no essential posting can't compete
                if reached > base + rest:
                    rows, score = rows[met], score[met]
            if len(rows) > k:
                reached = max(reached, int(np.partition(score, -k)[-k]))  # what is left only adds
                keep = score + rest >= reached
                rows, score = rows[keep], score[keep]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, vector); ``is_query`` is told of vec_id."""
    total = vectors.agg(F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    shards, blocks = (max(1, -(-n // size)) for n, size in ((total["rows"], SHARD), (total["queries"], BLOCK)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    place = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    of_block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")
    index = vectors.select(place.alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "vector")
    asked = vectors.where(is_query).select(every(shards).alias("shard"), of_block.alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        asks, width = group["asks"].to_numpy(bool), int(group["vector"].map(len).max())
        rows = _stacked(group["vector"], width)
        ids = group["vec_id"].to_numpy(np.int64)
        shard, out = Shard(ids[~asks], rows[~asks]), []
        for query_id, query in zip(ids[asks], rows[asks], strict=True):
            found, scores = shard.best(query_id, query, k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})

    of_shards = index.unionByName(asked).groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return of_shards.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
