"""Benchmark items inside documents, within an edit distance over words.

An item of n words is found where a passage of the document can be turned into it with at most
``(1 - similarity) * n`` word edits. The steps, for a block of items of bounded size at a time:

1. Word grams that a document shares with items give windows: an item, and where it would start. Windows with
   fewer shared grams than any passage within the distance must have (q-gram lemma) are left out; this is exact.
2. Each item-sized window is embedded by the CGK random walk, which turns edit distance into Hamming distance,
   several times with independent walks; keys of few sampled places of each embedding (bit-sampling LSH)
   make windows that agree with the item in any key candidates. ``walks * samples`` sets the recall.
3. Candidates are verified by the exact edit distance to the best passage around the window.

Words are runs of Unicode letters, digits and the marks on them, without case; in scripts that are written without
spaces, each character with its marks is a word. Defined results: null, empty and wordless
texts and items match nothing; repeated rows are all returned, with the same result; equal item texts are
all reported; a null item_id is reported as null; no documents give no rows, no items give no hits. Extra
columns pass through; of the columns named like a result, the result stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.llm.common import bare_name, pieces, sent

#: Blocks of scripts without spaces: Thai, Lao, Burmese, Khmer, Tai, Balinese, kana, bopomofo, Han, Yi, Javanese.
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF),
    (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
]


class _Kinds(dict):
    """Code points to what they are in a word: ``a`` letter or digit, ``u`` one of an unspaced script, ``m`` mark, else a space."""

    def __missing__(self, code: int) -> str:
        major = unicodedata.category(chr(code))[0]
        letter = "u" if any(a <= code <= b for a, b in UNSPACED) else "a"
        self[code] = {"L": letter, "N": letter, "M": "m"}.get(major, " ")
        return self[code]


_KINDS = _Kinds()
#: Words where the highest character is ASCII, or below the first mark; and words among kinds of characters.
_ASCII, _LATIN, _CODED = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W_]+"), re.compile(r"a[am]*|um*")
_HIGH = re.compile("[\u0300-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text; the kind of search is chosen by its highest character, the words are the same."""
    if text.isascii():
        return _ASCII.findall(text)
    if not _HIGH.search(text):
        return _LATIN.findall(text)
    return [text[a:b] for a, b in spans_of(text)]


def spans_of(text: str) -> list[tuple[int, int]]:
    """Where the words of a lower-cased text start and end, in code points."""
    if text.isascii():
        return [m.span() for m in _ASCII.finditer(text)]
    if not _HIGH.search(text):
        return [m.span() for m in _LATIN.finditer(text)]
    return [m.span() for m in _CODED.finditer(text.translate(_KINDS))]


GRAM = 3
#: Bytes of item texts that are sent to every executor at once; more items go in several blocks.
BLOCK_BYTES = 8 << 20
#: Independent walks, keys of each, and places in a key.
WALKS, SAMPLES, PLACES = 6, 24, 2
SYMBOLS = 1 << 12
HIT = "array<struct<item_id:bigint,distance:int,n_words:int,start:int,end:int>>"


def lowered(text: str) -> str:
    """``text`` without case, a code point for each; the only letter that would become two, and the final sigma, become plain."""
    return text if text.isascii() and text.islower() else text.replace("\u0130", "i").lower().replace("\u03c2", "\u03c3")


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    edits: int
    gram: int
    least: int


class Items:
    """A block of items, with their grams and the keys of their embeddings."""

    def __init__(self, rows: list[tuple[int | None, str]], similarity: float) -> None:
        self.ids: dict[str, int] = {}
        self.items: list[Item] = []
        for item_id, text in rows:
            if words := words_of(lowered(text or "")):
                codes = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64)
                n = len(codes)
                edits = int((1 - similarity) * n + 1e-9)
                # Edits leave at least this long a run of words as it is.
                gram = min(GRAM, -(-(n - edits) // (edits + 1)))
                self.items.append(Item(item_id, codes, edits, gram, max(1, n - gram + 1 - gram * edits)))
        rng = np.random.default_rng(1)
        longest = max((len(i.words) for i in self.items), default=1)
        self.steps = 3 * longest
        self.moves = rng.integers(0, 2, (WALKS, self.steps, SYMBOLS), np.uint8)
        self.places = rng.random((WALKS, SAMPLES, PLACES))
        self.mix = rng.integers(1, 1 << 62, PLACES) | 1
        self.grams = {g: self._grams(g) for g in sorted({i.gram for i in self.items})}
        self.keys = [self.keys_of(i.words[None, :]) for i in self.items]

    def _code(self, words: np.ndarray, gram: int) -> np.ndarray:
        code = words[: len(words) - gram + 1].copy()
        for i in range(1, gram):
            code = code * (len(self.ids) + 1) + words[i : len(words) - gram + 1 + i]
        return code

    def _grams(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted codes of the grams, and each one's item and place."""
        of = [(k, self._code(i.words, gram)) for k, i in enumerate(self.items) if i.gram == gram]
        codes = np.concatenate([c for _, c in of])
        item = np.concatenate([np.full(len(c), k) for k, c in of])
        place = np.concatenate([np.arange(len(c)) for _, c in of])
        order = np.argsort(codes, kind="stable")
        return codes[order], item[order], place[order]

    def keys_of(self, windows: np.ndarray) -> np.ndarray:
        """Keys (walks x samples, for each window) of windows of one length: the walk, then the sampled places."""
        count, n = windows.shape
        padded = np.concatenate([windows, np.full((count, 1), -1)], axis=1)
        symbol, rows, out = padded % SYMBOLS, np.arange(count), []
        for walk in range(WALKS):
            at, seen = np.zeros(count, np.int64), np.empty((3 * n, count), np.int64)
            for step in range(3 * n):
                seen[step] = padded[rows, at]
                at = np.minimum(at + self.moves[walk, step][symbol[rows, at]], n)
            # Most walks end after two steps a word; places beyond that would tell nothing.
            picked = seen[(self.places[walk] * 2 * n).astype(np.int64)]
            out.append((picked * self.mix[None, :, None]).sum(axis=1) ^ (picked[:, 0] << 7))
        return np.concatenate(out)

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items and the starts at which they may be found in a document."""
        for gram, (codes, item, place) in self.grams.items():
            if len(words) < gram:
                continue
            known = words >= 0
            whole = known[: len(words) - gram + 1].copy()
            for i in range(1, gram):
                whole &= known[i : len(words) - gram + 1 + i]
            (spots,) = np.nonzero(whole)
            if not len(spots):
                continue
            code = words[spots]
            for i in range(1, gram):
                code = code * (len(self.ids) + 1) + words[spots + i]
            low, high = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            each = high - low
            if not each.any():
                continue
            which = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            items, starts = item[which], np.repeat(spots, each) - place[which]
            order = np.lexsort((starts, items))
            items, starts = items[order], starts[order]
            heads = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
            for a, b in zip(heads, [*heads[1:], len(items)], strict=True):
                one = self.items[items[a]]
                if b - a < one.least:
                    continue
                here = starts[a:b]
                near = np.searchsorted(here, here + one.edits, "right") - np.searchsorted(here, here - one.edits, "left")
                if len(found := np.unique(here[near >= one.least])):
                    yield int(items[a]), found

    def hits(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, edits, words of the item, start, end) of the best passage of each item found; code points."""
        if not text or not self.items:
            return []
        lower = lowered(text)
        found = words_of(lower)
        get = self.ids.get
        words = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
        out, spans = [], None
        for k, starts in self.windows(words):
            item = self.items[k]
            n = len(item.words)
            best = None
            inside = np.clip(starts, 0, max(0, len(words) - 1))
            spread = inside[:, None] + np.arange(n)
            windows = np.where(spread < len(words), words[np.minimum(spread, len(words) - 1)], -2)
            agree = (self.keys_of(windows) == self.keys[k]).any(axis=0)
            for start in starts[agree]:
                lo, hi = max(0, int(start) - item.edits), min(len(words), int(start) + n + item.edits)
                distance, a, b = best_passage(item.words, words[lo:hi])
                if distance <= item.edits and (best is None or (distance, lo + a) < best[:2]):
                    best = (distance, lo + a, lo + b)
            if best:
                spans = spans or spans_of(lower)
                out.append((item.item_id, best[0], n, spans[best[1]][0], spans[best[2] - 1][1]))
        return sorted(out, key=lambda h: (h[3], h[4], h[0] is None, h[0] or 0))


def best_passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``words`` with the smallest edit distance to ``item``.

    Rows of the table run over the item; a cell holds distance and start as one number, so that the smaller
    distance wins, and of equal ones the later start.
    """
    m = len(words)
    base = m + 1
    place = np.arange(m + 1)
    row = base - 1 - place  # distance 0, starting anywhere
    for word in item:
        change = row[:-1] + np.where(words == word, 0, base)
        new = np.concatenate([[row[0] + base], np.minimum(change, row[1:] + base)])
        row = np.minimum.accumulate(new - place * base) + place * base
    distance, end = divmod(int(row.min()), base)[0], int(row.argmin())
    return distance, base - 1 - int(row[end] % base), end


def item_blocks(items: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The items in blocks of at most BLOCK_BYTES (or one item); the driver holds one block's texts at a time."""
    sized = items.select("item_id", "text").where("text is not null")
    size = sized.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-size // (BLOCK_BYTES // 2)))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == k).collect()]


def with_hits(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents with ``hits``, an array that is empty for clean documents."""
    found = docs.drop("hits")
    for block in item_blocks(items):
        found = _with_block(found, Items(block, similarity))
    return found


def _with_block(docs: DataFrame, items: Items) -> DataFrame:
    shared = sent(docs.sparkSession, items)
    kept = [f for f in docs.schema.fields if f.name != "hits"]
    out = T.StructType([*kept, T.StructField("hits", T._parse_datatype_string(HIT))])
    at, spots = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if c != "hits"]
    earlier = docs.columns.index("hits") if "hits" in docs.columns else None
    fields = ["item_id", "distance", "n_words", "start", "end"]
    kind = pa.list_(pa.struct([(f, pa.int64() if f == "item_id" else pa.int32()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared()
        for part in pieces(batches):
            hits = [[dict(zip(fields, h, strict=True)) for h in block.hits(t)] for t in part.column(at).to_pylist()]
            if earlier is not None:
                hits = [a + b for a, b in zip(part.column(earlier).to_pylist(), hits, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in spots], pa.array(hits, kind)], names=out.fieldNames())

    return docs.mapInArrow(run, out)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row per document row and item found in it."""
    hit = with_hits(docs.select("doc_id", "text"), items, similarity).select("doc_id", F.explode("hits").alias("hit"))
    share = (1 - F.col("hit.distance") / F.col("hit.n_words")).alias("similarity")
    return hit.select("doc_id", "hit.*", share)


def without_contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents in which no item is found."""
    packed = docs.select("text", F.struct(*[F.col(bare_name(c)) for c in docs.columns]).alias("given"))
    clean = with_hits(packed, items, similarity).where(F.size("hits") == 0)
    return clean.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
