"""Language of a document as a mixture: expectation-maximisation over byte trigram likelihoods.

Training counts the hashed byte trigrams of every document of each language. A document's trigrams are then
explained as a mixture of the languages: expectation-maximisation estimates its proportions. The set of
languages is selected by penalised likelihood: growing sets, in the order of their proportions, each with
proportions of its own, and the best value of log-likelihood less ``penalty * log(trigrams)`` per language
after the first. The prediction is the largest of the selected set.

Defined results: a null text, an empty one and one without a letter give ``und`` with score 0, as does every
text when no language was learned; languages of less than SUPPORT of the labelled documents are not learned; a null doc_id counts as the empty text for the fold; repeated rows are
returned as often as given; no rows give no rows. Extra columns pass through; of the columns named like a
result, the result stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.llm.common import pieces, sent

UNKNOWN = "und"
#: Trigrams are hashed to this many bits, so a model has 2**BITS numbers per language.
BITS = 16
#: Steps of expectation-maximisation; a language's log-likelihood price.
STEPS, PENALTY = 12, 1.0
#: Least share of the labelled documents that a language has to have to be learned; so a model has 1,000 languages at most.
SUPPORT = 0.001
#: Languages whose counts a worker holds before it hands them on.
HELD = 32
_LETTER = re.compile("[A-Za-z]")
_LETTERS = np.full(256, 32, np.uint8)
for _b in [*range(ord("a"), ord("z") + 1), *range(128, 256)]:
    _LETTERS[_b] = _b


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script; signs for numbers are none."""
    return bool(_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text's letters; everything else counts as a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    b = _LETTERS[raw].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``texts`` (text, lang) in languages with SUPPORT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, n in totals.items():
                (grams,) = np.nonzero(n)
                columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n[grams])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            totals.clear()

        for part in pieces(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if lang not in totals:
                    if len(totals) == HELD:
                        yield from handed()
                    totals[lang] = np.zeros(1 << BITS, np.int64)
                np.add.at(totals[lang], trigrams(text), 1)
        yield from handed()

    some = texts.where("text is not null and lang is not null").select("text", "lang")
    least = F.lit(SUPPORT) * some.agg(F.count("*").alias("n")).scalar()
    known = some.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    some = some.join(F.broadcast(known.select("lang")), "lang", "left_semi").select("text", "lang")
    return some.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """What is learned: names in order, and each trigram's log-probability in each language."""

    names: list[str]
    logs: np.ndarray

    @classmethod
    def learn(cls, texts: DataFrame) -> Languages:
        """From the counts, of which the driver gets 2**BITS numbers per language at most."""
        rows = trigram_counts(texts).toPandas()
        names = sorted(rows["lang"].unique())
        counts = np.full((1 << BITS, len(names)), 0.5)
        at = {name: i for i, name in enumerate(names)}
        np.add.at(counts, (rows["gram"].to_numpy(np.int64), rows["lang"].map(at).to_numpy(np.int64)), rows["n"].to_numpy(float))
        return cls(names, np.log(counts / counts.sum(axis=0)) if names else counts)


def _mixtures(
    p: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document over its ``allowed`` languages, and what no proportions can exceed.

    The likelihood is concave in the proportions, so its best value is above that found by the duality gap at most.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(STEPS):
        each = p * share[doc]
        share = np.add.reduceat(each * (n / each.sum(axis=1))[:, None], starts, axis=0) / total
    mixed = (p * share[doc]).sum(axis=1)
    value = np.add.reduceat(n * np.log(mixed), starts)
    slope = np.add.reduceat(p * (n / mixed)[:, None], starts, axis=0) / total
    return share, value, value + total[:, 0] * (np.where(allowed > 0, slope, 0).max(axis=1) - 1)


def mixtures(grams: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The selected proportions (documents x languages) of documents with a trigram each at least."""
    ordered = [np.sort(g, kind="stable") for g in grams]
    edges = [np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) for g in ordered]
    n = np.concatenate([np.diff(e, append=len(g)) for e, g in zip(edges, ordered, strict=True)]).astype(float)
    kinds = np.array([len(e) for e in edges])
    log_p = logs[np.concatenate([g[e] for e, g in zip(edges, ordered, strict=True)])]
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)

    def sub(which: np.ndarray) -> tuple[np.ndarray, ...]:
        rows = np.repeat(which, kinds)
        k = kinds[which]
        return p[rows], n[rows], np.cumsum(k) - k, np.repeat(np.arange(len(k)), k)

    count, languages = len(grams), logs.shape[1]
    everyone = np.ones(count, bool)
    _, _, starts, doc = sub(everyone)
    alone = np.add.reduceat(n[:, None] * (log_p - top), starts, axis=0)
    full, _, reach = _mixtures(p, n, starts, doc, np.ones((count, languages)))
    order = np.argsort(-full, axis=1, kind="stable")
    price = PENALTY * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    best, shares = alone.max(axis=1), np.zeros((count, languages))
    shares[np.arange(count), alone.argmax(axis=1)] = 1
    for size in range(2, languages + 1):
        # No set of this size can win where even all languages together explain too little more.
        open_ = reach - (size - 1) * price > best
        if not open_.any():
            break
        allowed = np.zeros((int(open_.sum()), languages))
        np.put_along_axis(allowed, order[open_, :size], 1, axis=1)
        got, value, _ = _mixtures(*sub(open_), allowed)
        value -= (size - 1) * price[open_]
        won = np.flatnonzero(open_)[value > best[open_]]
        shares[won], best[won] = got[value > best[open_]], value[value > best[open_]]
    return shares, full


def with_languages(docs: DataFrame, model: Languages) -> DataFrame:
    """The documents and ``lang_pred``, ``score`` (its proportion) and ``languages`` (the selected set with proportions)."""
    shared = sent(docs.sparkSession, model)
    results = {"lang_pred": "string", "score": "double", "languages": "map<string,double>"}
    kept = [f for f in docs.schema.fields if f.name not in results]
    out = T.StructType([*kept, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in results.items()]])
    spots = [i for i, c in enumerate(docs.columns) if c not in results]
    at = docs.columns.index("text")

    def predicted(texts: list[str | None], known: Languages) -> tuple[list, list, list]:
        names, logs = known.names, known.logs
        pred, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        some = [i for i, t in enumerate(texts) if names and t is not None and has_letter(t)]
        if some:
            shares, full = mixtures([trigrams(texts[i]) for i in some], logs)
            for i, share, whole in zip(some, shares, full, strict=True):
                first = int(share.argmax())
                pred[i], score[i] = names[first], float(min(1.0, whole[first]))
                sets[i] = [(names[k], float(share[k])) for k in np.flatnonzero(share)]
        return pred, score, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for part in pieces(batches):
            pred, score, sets = predicted(part.column(at).to_pylist(), known)
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            columns = [part.column(i) for i in spots] + new
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return docs.mapInArrow(run, out)


def identified(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns from the documents outside the fold and predicts all of them; adds ``held_out`` too."""
    model = Languages.learn(docs.where(~held_out("doc_id", folds, fold)).select("text", "lang"))
    return with_languages(docs.withColumn("held_out", held_out("doc_id", folds, fold)), model)
