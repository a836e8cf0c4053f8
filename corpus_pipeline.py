"""From raw documents to token ids: five stages, each a call of one operator of ``inktally.llm``, with which this file comes and goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inktally.llm import queries
from inktally.llm.bpe import encoded_and_decoded
from inktally.llm.common import given, stored
from inktally.llm.decontaminate import without_contaminated
from inktally.llm.language_id import UNKNOWN, identified
from inktally.llm.line_dedup import without_repeated_lines
from inktally.llm.simhash import without_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter."""
    told = identified(queries.packed(docs)).where(F.col("lang_pred") != UNKNOWN)
    return queries.unpacked(told, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows."""
    kept = without_repeated_lines(queries.packed(docs))
    text = F.col("kept")
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return kept.select(*[new.get(c, F.col("given").getField(c).alias(c)) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints of three-word shingles within two bits, the document with the smallest doc_id stays."""
    return without_near_duplicates(docs, budget=2, shingle=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, given(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to, beside doc_id, lang and source; other columns end here."""
    texts = docs.select("doc_id", "lang", "source", F.col("text").alias("decoded"))
    back = encoded_and_decoded(texts, queries.vocabulary(), text="decoded")
    return back.select("doc_id", "lang", "source", "ids", *queries.token_digests())


#: The stages in order; each takes what the one before kept.
STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: SQL can express neither the language model nor the walks nor the merges; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
