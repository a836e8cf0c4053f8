"""Byte-level BPE of a public vocabulary: encoding and decoding.

A text is cut at the vocabulary's added tokens, then into words. Of a word, the encoder holds the part
boundaries and, next to them, the rank of each adjacent pair; it looks for the smallest rank, deletes that
boundary and refreshes the two neighbouring ranks, until no pair has a rank. Words repeat, so a worker keeps
those it has encoded, up to a number.

Defined results: a null text is encoded as the empty one, to no ids; null ids decode to a null text;
repeated rows are returned as often as given; no rows give no rows. Extra columns pass through; of the
columns named like a result, the result stays. Ids are little-endian unsigned 32-bit numbers in a binary.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inktally.llm.common import pieces, sent

#: Fixed value: how byte-level vocabularies of this kind cut words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
#: Parts from which the minimum is kept in a heap, since looking through them again and again takes too long.
LONG = 400
#: Encoded words that a worker keeps.
KEPT = 150_000


def _byte_letters() -> dict[str, int]:
    """Letter by which a byte-level vocabulary writes each byte: printable ones as they are, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Token bytes by id, the rank of each pair of ids, and the tokens that a text is cut at first."""

    tokens: dict[int, bytes]
    ranks: dict[tuple[int, int], int]
    merged: list[int]
    added: dict[str, int]
    bytes_: list[int] = field(default_factory=list)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """A vocabulary file with vocab, merges and added tokens; read by the driver, then sent out."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, ids = _byte_letters(), told["model"]["vocab"]
        tokens = {i: bytes(letters[c] for c in word) for word, i in ids.items()}
        added = {a["content"]: a["id"] for a in told["added_tokens"]}
        tokens |= {i: word.encode() for word, i in added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        by_letter = {b: ids[c] for c, b in letters.items()}
        return cls(tokens, ranks, [ids[a + b] for a, b in pairs], added, [by_letter[b] for b in range(256)])


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN).findall
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def parts(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids, ranks_of, merged = [self.v.bytes_[b] for b in word], self.v.ranks.get, self.v.merged
        if len(ids) > LONG:
            return self._long(ids)
        ranks = [ranks_of(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != NONE:
            i = ranks.index(rank)
            ids[i : i + 2] = [merged[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = ranks_of((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = ranks_of((ids[i], ids[i + 1]), NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same for long words: parts are linked, and a heap gives the leftmost smallest rank."""
        ranks_of, n = self.v.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks_of((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.v.merged[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks_of((ids[k], ids[after[k]]), NONE)) != NONE:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x in ids if x != -1]

    def _word(self, word: str) -> bytes:
        found = np.array(self.parts(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.words) >= KEPT:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        known, out = self.words.get, []
        for n, part in enumerate(self.added.split(text) if self.added else [text]):
            if n % 2:
                out.append(self.v.added[part].to_bytes(4, "little"))
            else:
                out += [known(word) or self._word(word) for word in self.cut(part)]
        return b"".join(out)


def _mapped(frame: DataFrame, source: str, results: dict[str, T.DataType], function) -> DataFrame:  # noqa: ANN001
    """``frame`` with ``results``, a tuple of which ``function()`` (once a task) makes from each value of ``source``."""
    kept = [i for i, c in enumerate(frame.columns) if c not in results]
    out = T.StructType([*[frame.schema.fields[i] for i in kept], *[T.StructField(c, kind) for c, kind in results.items()]])
    at = frame.columns.index(source)
    arrow = [pa.binary() if isinstance(kind, T.BinaryType) else pa.string() for kind in results.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = function()
        for part in pieces(batches):
            rows = [make(x) for x in part.column(at).to_pylist()]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *made], names=out.fieldNames())

    return frame.mapInArrow(run, out)


def _text_of(tokens: dict[int, bytes], ids: bytes) -> str:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text."""
    shared = sent(docs.sparkSession, vocabulary)

    def function():  # noqa: ANN202
        encoder = Encoder(shared())
        return lambda value: (encoder.encode(value or ""),)

    return _mapped(docs, text, {ids: T.BinaryType()}, function)


def decoded(frame: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the text of its ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
    shared = sent(frame.sparkSession, vocabulary.tokens)

    def function():  # noqa: ANN202
        tokens = shared()
        return lambda value: (None if value is None else _text_of(tokens, value),)

    return _mapped(frame, ids, {text: T.StringType()}, function)


def encoded_and_decoded(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", back: str = "decoded"
) -> DataFrame:
    """``encoded``, then ``decoded`` of those ids, by one worker a task instead of two, which holds one vocabulary.

    Where ``back`` is ``text``, the text is replaced and does not return from the worker.
    """
    shared = sent(docs.sparkSession, vocabulary)

    def function():  # noqa: ANN202
        encoder = Encoder(shared())

        def both(value: str | None) -> tuple[bytes, str]:
            found = encoder.encode(value or "")
            return found, _text_of(encoder.v.tokens, found)

        return both

    return _mapped(docs, text, {ids: T.BinaryType(), back: T.StringType()}, function)
