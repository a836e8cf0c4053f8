"""Chat formatting: conversations as one text each, their tokens, and which of these are learned.

A turn becomes ``<s>[INST]role[/INST]text</s>``, and a conversation its turns in order, so that every role and text
stands between control strings. Control strings inside roles and texts are escaped: a backslash is put behind
their first character, also where some stand there already, so taking one away again gives back what was written.

A conversation is rendered whole and encoded once. The encoder knows the control strings as tokens, so
no token crosses a turn's border. Turns that are learned are spans of the text, sorted as the tokens' offsets are;
a binary search for both ends of each gives the range of tokens that the loss covers.

Turns are dealt by ranges of (conversation, turn), and a task writes each conversation as it reads it. A
conversation that is too long for a row, or that a range's border cuts, comes in several rows in the order of
``place``; since control strings cut the text for the encoder, their tokens are those of the whole.

Defined results: a null text or role is empty; a null conversation id is an id like others; rows without a turn come
first, rows with equal turns follow a hash of role and text; repeated rows are turns of their own; no rows
give no rows. Only conv_id, turn, role and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inktally.llm.common import pieces, sent

#: Code points and turns after which a conversation goes on in a new row.
PART_CHARS, PART_TURNS = 1 << 20, 1 << 14
#: Texts that are encoded at once.
GROUP = 64


@dataclass(frozen=True)
class Template:
    """How turns are written, whose turns are learned, and which further strings the encoder takes for tokens."""

    start: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = ("<|endoftext|>",)

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.start, self.role, self.text, self.end)

    def __post_init__(self) -> None:
        known = (*self.marks, *self.reserved)
        for one in known:
            if len(one) < 2 or "\\" in one or any(one[0] in other[1:] for other in known):
                raise ValueError(f"{one!r} cannot be told from another control string, or cannot be escaped")

    def _pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(f"({re.escape(c[0])}){slashes}(?={re.escape(c[1:])})" for c in (*self.marks, *self.reserved)))

    def escaped(self, text: str) -> str:
        return _escape(self).sub(lambda m: m.group() + "\\", text)

    def plain(self, text: str) -> str:
        return _plain(self).sub(lambda m: m.group()[:-1], text) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn as it is written, and where its text starts and ends there."""
        head = f"{self.start}{self.role}{self.escaped(role)}{self.text}"
        body = self.escaped(text)
        return f"{head}{body}{self.end}", len(head), len(head) + len(body)

    def turns(self, written: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a written text."""
        each = written.split(self.start + self.role)[1:]
        halves = (t[: -len(self.end)].split(self.text, 1) for t in each)
        return [(self.plain(role), self.plain(text)) for role, text in halves]


@lru_cache
def _escape(template: Template) -> re.Pattern:
    return template._pattern(r"\\*")


@lru_cache
def _plain(template: Template) -> re.Pattern:
    return template._pattern(r"\\+")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, marks: tuple[str, ...]):
    """The tokenizer of a vocabulary (the text of its file) that knows the control strings as tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_str(vocabulary)
    made.no_truncation()
    made.no_padding()
    made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in marks])
    return made


def token_ranges(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each of the sorted spans (start, end) the range (first, after the last) of tokens that share a character with it."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    return np.stack([first, np.maximum(first, last)], axis=1)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in ranges of conversations and turns, sorted; equal rows of one turn may be cut apart."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role, text)
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn("nth", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("conv_id", "turn", "tie", "nth")
    return dealt.sortWithinPartitions("conv_id", "turn", "tie", "role", "text").select("conv_id", "role", "text")


FORMATTED = "conv_id long, place long, whole boolean, text string, ids array<int>, loss array<struct<first:int,last:int>>"
_RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def formatted(conversations: DataFrame, vocabulary: str, template: Template | None = None) -> DataFrame:
    """One row a conversation, or several in the order of ``place``: its text, token ids, and ranges of tokens to be learned.

    ``vocabulary`` is the text of a tokenizer's file. ``whole`` tells rows that surely hold all of a conversation.
    """
    used = template or Template()
    shared = sent(conversations.sparkSession, (vocabulary, used))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, whole, text, spans); the first and the last conversation of a range may have more rows elsewhere."""
        now, turns, spans, size, cut, begun = None, [], [], 0, True, False
        for part in pieces(batches):
            for conv, role, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                other = begun and conv != now
                if other or size >= PART_CHARS or len(turns) >= PART_TURNS:
                    yield now, other and not cut, "".join(turns), spans
                    turns, spans, size, cut = [], [], 0, not other
                now, begun = conv, True
                written, start, end = used.turn(role, text)
                if role in used.learned:
                    spans.append((size + start, size + end))
                turns.append(written)
                size += len(written)
        if turns:
            yield now, False, "".join(turns), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, known = shared()
        library = encoder(text_of, known.marks)
        place, held, chars = TaskContext.get().partitionId() << 33, [], 0

        def encoded() -> pa.RecordBatch:
            ids, loss = [], []
            for (_, _, _, spans), found in zip(held, library.encode_batch([h[2] for h in held], add_special_tokens=False), strict=True):
                ids.append(np.array(found.ids, np.int32))
                offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
                ranges = token_ranges(np.array(spans, np.int64).reshape(-1, 2), offsets)
                loss.append([{"first": a, "last": b} for a, b in ranges.tolist()])
            columns = [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array(np.arange(place, place + len(held))),
                pa.array([h[1] for h in held], pa.bool_()),
                pa.array([h[2] for h in held], pa.string()),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(loss, _RANGES),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "whole", "text", "ids", "loss"])

        for one in rendered(batches):
            held.append(one)
            chars += len(one[2])
            if len(held) >= GROUP or chars >= PART_CHARS:
                yield encoded()
                place, chars = place + len(held), 0
                held.clear()
        if held:
            yield encoded()

    return ordered_turns(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, FORMATTED)


def read_back(rows: DataFrame, vocabulary: str, template: Template | None = None) -> DataFrame:
    """What :func:`formatted` says of each conversation, read from its rows alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): turns are parsed from the text, and
    the learned text is decoded from the tokens under the mask. A row that holds a whole conversation passes on digests
    only; the rest are shuffled by their conversation and hashed in order, a row at a time.
    """
    used = template or Template()
    shared = sent(rows.sparkSession, (vocabulary, used))
    names = ["conv_id", "place", "whole", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    layout = "conv_id long, place long, whole boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, known = shared()
        library = encoder(text_of, known.marks)
        for part in pieces(batches, GROUP):
            out = []
            for conv, place, whole, text, ids, loss in zip(*[part.column(i).to_pylist() for i in range(6)], strict=True):
                turns = known.turns(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns).encode()
                runs = library.decode_batch([ids[r["first"] : r["last"]] for r in loss], skip_special_tokens=False)
                learned = "".join(map(known.plain, runs))
                pack = (lambda raw: hashlib.sha256(raw).digest()) if whole else (lambda raw: zlib.compress(raw, 1))
                out.append((conv, place, whole, len(turns), pack(said), len(learned), pack(learned.encode()), len(text)))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, digests = None, None, None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([o[i] for o in out], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def ended() -> tuple:
            return (now, sums[0], digests[0].hexdigest(), sums[1], digests[1].hexdigest(), sums[2])

        for part in pieces(batches, GROUP):
            for conv, _, whole, turns, said, chars, learned, size in zip(*[part.column(i).to_pylist() for i in range(8)], strict=True):
                if sums is not None and (conv != now or whole):
                    out.append(ended())
                    sums = None
                if whole:
                    out.append((conv, turns, said.hex(), chars, learned.hex(), size))
                    continue
                if sums is None:
                    now, sums, digests = conv, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [sums[0] + turns, sums[1] + chars, sums[2] + size]
                digests[0].update(zlib.decompress(said))
                digests[1].update(zlib.decompress(learned))
            if out:
                yield batch()
        if sums is not None:
            out.append(ended())
            yield batch()

    each = rows.mapInArrow(told, layout).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return each.mapInArrow(merged, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
