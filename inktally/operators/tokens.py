"""Token counts of texts with a given byte-pair vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the public split pattern of the cl100k_base vocabulary, whose
#: rank file is the one that ``text-embedding-3-small`` uses.
CL100K_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+"
    r"|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
)

#: Strings that stand for special tokens of that vocabulary.
CL100K_SPECIAL = (
    "<|endoftext|>",
    "<|fim_prefix|>",
    "<|fim_middle|>",
    "<|fim_suffix|>",
    "<|endofprompt|>",
)

#: Texts of a batch that are Python strings at a time.
_AT_A_TIME = 256


def batch_lengths(at_a_time: int = _AT_A_TIME):
    """Function from an encoder and a batch of texts to their token counts; it travels to workers by value.

    Each distinct text of a batch is encoded once, and few of them at a time are Python's: a worker holds the
    batch, which Spark bounds by rows and bytes, and its distinct texts.
    """

    def lengths(encode, texts: pa.Array) -> pa.Array:
        coded, found = texts.dictionary_encode(), []
        for at in range(0, len(coded.dictionary), at_a_time):
            found += [len(encode(t)) for t in coded.dictionary.slice(at, at_a_time).to_pylist()]
        out = pa.array(found, pa.int64()).take(coded.indices)
        # What the batch took goes back; else a worker keeps as much as its largest batch took.
        del coded
        pa.default_memory_pool().release_unused()
        return out

    return lengths


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary: the rank of each byte sequence and the pattern that splits text.

    A special string inside a text is ordinary text, unless ``refuse_special``
    asks that such a text fail its table.
    """

    pattern: str
    ranks: Mapping[bytes, int] = field(repr=False)
    special: tuple[str, ...] = CL100K_SPECIAL
    refuse_special: bool = False

    def __post_init__(self) -> None:
        if self.refuse_special and not self.special:
            raise ValueError("refuse_special needs the special strings to refuse")

    @classmethod
    def from_rank_file(cls, path: str, pattern: str = CL100K_PATTERN, **options) -> Tokenizer:
        """Vocabulary from a file of ``base64 rank`` lines."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        return cls(pattern, ranks, **options)

    @property
    def name(self) -> str:
        digest = hashlib.sha256(self.pattern.encode())
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            digest.update(b"%d %b\n" % (rank, token))
        return f"inktally-{digest.hexdigest()[:16]}"

    def counter(self, spark: SparkSession):
        """Function from a text column to its token counts (an Arrow function).

        The vocabulary is broadcast once; its size is that of the vocabulary
        and does not grow with the data.  Each Python worker builds its encoder
        once and keeps it in the tokenizer library's own registry.
        """
        name, lengths = self.name, batch_lengths()
        shared = spark.sparkContext.broadcast((self.pattern, dict(self.ranks)))

        @F.arrow_udf(T.LongType())
        def count(texts: pa.Array) -> pa.Array:
            import tiktoken
            from tiktoken import registry

            encoder = registry.ENCODINGS.get(name)
            if encoder is None:
                pattern, ranks = shared.value
                encoder = tiktoken.Encoding(
                    name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
                )
                registry.ENCODINGS[name] = encoder
            return lengths(encoder.encode_ordinary, texts)

        return lambda text: count(self.guarded(text))

    def with_count(self, frame: DataFrame, text: str = "page_content", name: str = "token_count") -> DataFrame:
        """``frame`` with the token counts of a text column.

        The text is made in a step of its own: Spark does not always find a Python
        function around an expression with lambdas, but does around a column.
        """
        made = frame.select("*", F.explode(F.array(F.col(text))).alias("_counted"))
        return made.withColumn(name, self.counter(frame.sparkSession)(F.col("_counted"))).drop("_counted")

    def guarded(self, text: Column) -> Column:
        """``text``, failing on special strings if they are refused."""
        if self.refuse_special:
            for mark in self.special:
                message = F.lit(f"The text contains a special token that is not allowed: {mark}")
                text = F.when(F.contains(text, F.lit(mark)), F.raise_error(message)).otherwise(text)
        return text

    def rank_table(self, spark: SparkSession) -> DataFrame:
        """The vocabulary as rows of ``token`` (binary) and ``rank``."""
        tokens = pa.table(
            {
                "token": pa.array(list(self.ranks), pa.binary()),
                "rank": pa.array(list(self.ranks.values()), pa.int32()),
            }
        )
        return spark.createDataFrame(tokens)


def piece_counts(
    documents: DataFrame,
    tokenizer: Tokenizer,
    text: str = "page_content",
    by: tuple[str, ...] = ("schema", "table"),
    times: str | None = None,
) -> DataFrame:
    """How often each piece of the split pattern occurs, per table or other group.

    The null piece counts the documents themselves.  The JVM splits and counts;
    ``(?U)`` makes ``\\s`` mean Unicode white space, as it does in the
    tokenizer.  Texts are cut where they are read, and counts are added up before the
    shuffle: no text is shuffled, and a frequent piece is one row per task.  ``times``
    names a column of how many documents have the text of a row; else each row is one.
    """
    pattern = F.lit(f"(?U){tokenizer.pattern}")
    found = F.regexp_extract_all(tokenizer.guarded(F.col(text)), pattern, F.lit(0))
    pieces = F.concat(F.array(F.lit(None).cast("string")), found)
    return (
        documents.select(*by, *([times] if times else []), F.explode(pieces).alias("piece"))
        .where("piece is null or piece <> ''")
        .groupBy(*by, "piece")
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("piece_count"))
    )


def piece_tokens(
    pieces: DataFrame, tokenizer: Tokenizer, by: tuple[str, ...] = ("schema", "table")
) -> DataFrame:
    """Documents and token totals per group from :func:`piece_counts`.

    A piece that is in the vocabulary is one token; an equi-join finds those.
    Only the others are encoded by the tokenizer library, once per group; it
    sees nulls in place of the first.
    """
    counter = tokenizer.counter(pieces.sparkSession)
    ranks = tokenizer.rank_table(pieces.sparkSession)
    joined = pieces.withColumn("token", F.encode("piece", "utf-8")).join(ranks, "token", "left")
    rare = F.when(F.col("rank").isNull(), F.col("piece"))
    length = F.when(F.col("rank").isNotNull(), 1).otherwise(counter(rare))
    return joined.withColumn("length", length).groupBy(*by).agg(
        F.sum(F.when(F.col("piece").isNull(), F.col("piece_count")).otherwise(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("length") * F.col("piece_count")), F.lit(0)).alias("token_count"),
    )


def doc_tokens(
    documents: DataFrame, tokenizer: Tokenizer, by: tuple[str, ...], text: str = "page_content"
) -> DataFrame:
    """The token count of each document, beside the columns ``by``.

    Documents share few pieces, so each is encoded where it is read, in Arrow
    batches; nothing is shuffled.
    """
    return tokenizer.with_count(documents, text).select(*by, "token_count")
