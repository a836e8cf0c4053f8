"""Toxicity of documents by a counterfactually regularised logistic classifier.

Features of a text are its words and their beginnings. Over all labelled rows of the training fold, Spark counts
in how many texts of either label each feature is; the features that tell the labels apart best, a bounded
number, are kept. The weights are fitted on a bounded sample of labelled rows. For each sampled text that names a
group of people, a counterfactual names the next group instead, and the squared change of the score is penalised:
words for groups don't make a neutral text toxic. Weights are sparse.

Defined results: a null text is the empty one; an empty text gets the score of a text without known features;
without labels of both kinds, every score is the share of label 1 (0 without labels); of several labels of a
doc_id the largest counts; a null doc_id has no label and counts as the empty text for the fold; repeated rows are
returned as often as given; no rows give no rows. Labels, lang, source and doc_id are no features.
Extra columns pass through; of the columns named like a result, the result stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.llm.common import pieces, sent, stored

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are features besides the word; features are hashed to this many bits.
HEADS, BITS = (3, 4, 5, 6, 7), 20
#: Features kept, and texts that must have one; labelled rows sampled for the fit.
FEATURES, LEAST, SAMPLE = 4000, 5, 40_000
#: Price of a weight; of a change under a swap; steps of the fit.
SPARSE, SWAPPED, STEPS = 2e-4, 1.0, 400
#: Words whose features a worker keeps.
KEPT = 150_000
#: Words for groups of people, by what they are exchanged for.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "citoyens"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "ciudadanos"),
)
SWAP = {word: group[(i + 1) % len(group)] for group in GROUPS for i, word in enumerate(group)}


def features_of(word: str) -> tuple[int, ...]:
    """The word and its beginnings, hashed."""
    mask = (1 << BITS) - 1
    heads = [zlib.crc32(b"^" + word[:n].encode()) & mask for n in HEADS if len(word) > n]
    return tuple({zlib.crc32(word.encode()) & mask, *heads})


class Features:
    """Features of texts; keeps those of words it has seen. ``only``: the features that count, if not all do."""

    def __init__(self, only: np.ndarray | None = None) -> None:
        self.only = None if only is None else {int(f): i for i, f in enumerate(only)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = features_of(word)
        if self.only is not None:
            found = tuple(self.only[f] for f in found if f in self.only)
        if len(self.seen) >= KEPT:
            self.seen.clear()
        self.seen[word] = found
        return found

    def of(self, words: Iterable[str]) -> list[int]:
        seen, out = self.seen, set()
        for word in words:
            found = seen.get(word)
            out.update(self._word(word) if found is None else found)
        return sorted(out)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def label_counts(labelled: DataFrame) -> DataFrame:
    """(feature, with_0, with_1): texts of either label that have a feature, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(), np.zeros((2, 1 << BITS), np.int32)
        for part in pieces(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts[label][features.of(words_of(text))] += 1
        (some,) = np.nonzero(counts.any(axis=0))
        columns = [pa.array(some.astype(np.int32)), *[pa.array(c[some].astype(np.int64)) for c in counts]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "with_0", "with_1"])

    each = labelled.select("text", "label").mapInArrow(run, "feature int, with_0 long, with_1 long")
    return each.groupBy("feature").agg(F.sum("with_0").alias("with_0"), F.sum("with_1").alias("with_1"))


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, labelled: DataFrame, most: int = FEATURES, sample: int = SAMPLE) -> Model:
        """From (text, label); the driver gets ``most`` features and what ``sample`` rows have of them, about."""
        total = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
        n, ones = total["n"], total["ones"] or 0
        if not 0 < ones < n:
            return cls(np.empty(0, np.int64), np.empty(0), np.inf * (1 if ones else -1))
        a, b = F.col("with_1"), F.col("with_0")
        # The chi-square of the table of feature and label.
        off = (a * float(n) - (a + b) * float(ones)) ** 2 / ((a + b) * (float(n) - (a + b) + 1))
        kept = label_counts(labelled).where((a + b >= LEAST) & (a + b < n)).orderBy(off.desc(), "feature").limit(most).collect()
        chosen = np.array(sorted(r["feature"] for r in kept), np.int64)
        share = min(1.0, sample / n)
        lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(chosen)
            for part in pieces(batches):
                words = [words_of(t) for t in part.column(0).to_pylist()]
                own = [features.of(w) for w in words]
                other = [features.of({SWAP.get(x, x) for x in w}) if not SWAP.keys().isdisjoint(w) else None for w in words]
                arrays = [pa.array(x, pa.list_(pa.int32())) for x in (own, other)]
                yield pa.RecordBatch.from_arrays([part.column(1), *arrays], names=["label", "own", "other"])

        rows = labelled.where(lot).select("text", "label").mapInArrow(run, "label int, own array<int>, other array<int>").toPandas()
        return cls(chosen, *fitted(rows["own"].tolist(), rows["label"].to_numpy(float), rows["other"].tolist(), len(chosen)))

    def score(self, found: list[int]) -> float:
        if np.isinf(self.intercept):
            return float(self.intercept > 0)
        at = self.intercept + float(self.weights[found].sum())
        return float(1 / (1 + np.exp(-np.clip(at, -500, 500))))


def fitted(
    own: list, label: np.ndarray, other: list, count: int, sparse: float = SPARSE, swapped: float = SWAPPED
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal steps; ``other``: the features after the swap, or None."""

    def table(lists: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*map(np.asarray, lists), []]).astype(np.int64)

    n = len(label)
    rows, cols = table(own)
    both = [(a, b) for a, b in zip(own, other, strict=True) if b is not None]
    less, more = table([list(set(a) - set(b)) for a, b in both]), table([list(set(b) - set(a)) for a, b in both])
    # A bound of the curvature along each feature gives its step.
    width = np.bincount(rows, minlength=n)
    curve = np.bincount(cols, width[rows] + 1.0, count) / (4 * n) + 1e-6
    if both:
        changed = np.bincount(less[0], minlength=len(both)) + np.bincount(more[0], minlength=len(both))
        for r, c in (less, more):
            curve += 2 * swapped * np.bincount(c, changed[r].astype(float), count) / n
    rate = label.mean()
    weights, intercept = np.zeros(count), float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 0.0
    base_curve = (width.mean() + 1) / 4
    ahead, ahead_b, pace = weights.copy(), intercept, 1.0
    for _ in range(STEPS):
        at = ahead_b + np.bincount(rows, ahead[cols], n)
        error = (1 / (1 + np.exp(-at)) - label) / n
        slope = np.bincount(cols, error[rows], count)
        if both:
            change = np.bincount(more[0], ahead[more[1]], len(both)) - np.bincount(less[0], ahead[less[1]], len(both))
            pull = 2 * swapped * change / n
            slope += np.bincount(more[1], pull[more[0]], count) - np.bincount(less[1], pull[less[0]], count)
        new = ahead - slope / curve
        new = np.sign(new) * np.maximum(np.abs(new) - sparse / curve, 0)
        new_b = ahead_b - error.sum() / base_curve
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, ahead_b = new + (pace - 1) / faster * (new - weights), new_b + (pace - 1) / faster * (new_b - intercept)
        weights, intercept, pace = new, new_b, faster
    return weights, float(intercept)


def in_fold(folds: int, fold: int):  # noqa: ANN201
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def learned(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> Model:
    """From the labels of documents outside the fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(~in_fold(folds, fold))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    texts = docs.where(~in_fold(folds, fold)).select("doc_id", "text")
    # Labels grow with the documents, so they are never broadcast, also while they are few.
    labelled = texts.hint("merge").join(known, "doc_id").select("doc_id", "text", "label")
    return Model.fit(stored(labelled, "labelled"))


def with_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents with ``score`` and ``predicted``."""
    useful = np.flatnonzero(model.weights)
    small = Model(model.features[useful], model.weights[useful], model.intercept)
    shared = sent(docs.sparkSession, small)
    kept = [i for i, c in enumerate(docs.columns) if c not in ("score", "predicted")]
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    out = T.StructType([*[docs.schema.fields[i] for i in kept], *new])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        features = Features(known.features)
        for part in pieces(batches):
            scores = [known.score(features.of(words_of(t))) for t in part.column(at).to_pylist()]
            marks = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(scores, pa.float64()), marks], names=out.fieldNames())

    return docs.mapInArrow(run, out)
