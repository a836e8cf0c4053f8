"""Phrases whose words keep company, by exact counts of all phrases.

A task counts in tries: a shallow trie over word ids, whose leaves are hash containers. A container holds the phrases
of a range of ids; one with too many bursts at a border between words, first words at the top, second words below.
The container of a trie that holds the most is spilled, as a whole subtree, when a task holds too many phrases:
a run, sorted by its words. Runs are merged by prefix partitions, a prefix being a phrase's first two words; each
partition is cut 64 ways, so that a prefix with very many phrases is not one task's.

Texts are read twice: phrases of one and two words are counted first, then those of three whose halves, the first two
words and the last two, are both frequent. A bit filter of bounded size tells these, by hashes of the words where they
stand; only words of phrases that it lets through are numbered. What it lets through by accident is counted and found to
be rare, so the result is exact however full the filter is.

A phrase of two or three words that occurs ``least`` times and more is a candidate. It is cut in two at each
place; the lowest score, a * a / (l * r) in millionths, rounded down, counts. A candidate within a longer one that
occurs half as often and more is dropped. Whatever is in a candidate occurs as often as it does at least, so
only phrases with ``least`` occurrences are joined; numbers have 38 digits where they are multiplied.

Words are runs of other than spaces and tabs, in pieces that end at ``.,;:!?`` and line ends; A-Z are lower-cased.
Defined results: a null text is empty; a null language is ``und`` and counts with it; repeated rows count as often
as given; ties are in order of the phrase's bytes; no rows give no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inktally.llm.common import pieces, sent, stored
from inktally.llm.suffix_dedup import Hasher

UNKNOWN = "und"
#: Words of the longest phrase, and bits of a word's id in a phrase's code.
WORDS, BITS = 3, 21
#: Bytes whose words are counted at once; phrases in a container before it bursts, and in a task before it spills.
CHUNK, BURST, HELD = 1 << 20, 1 << 14, 1 << 20
#: Words that a task knows by number before it spills all and starts anew; languages that it counts at a time.
VOCABULARY, LANGUAGES = 1 << 19, 64
#: Bits of the filter for each frequent phrase, and in all (32 MB).
BITS_EACH, BITS_MOST = 16, 1 << 28
#: Words of 64 bits in a block of the filter, which the driver gets whole.
BLOCK = 1 << 13
#: Prefix partitions' numbers, and parts of one.
CELLS, SALTS = 1 << 20, 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


class Trie:
    """Counts of codes, word ids packed from the top bits down, in hash containers for ranges of codes."""

    def __init__(self, burst: int) -> None:
        self.burst = burst
        self.low: list[int] = [0]
        self.held: list[dict[int, int]] = [{}]
        self.whole: set[int] = set()  # lower ends of containers that hold one prefix and cannot burst

    def size(self) -> int:
        return sum(map(len, self.held))

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Adds sorted, distinct codes."""
        cuts = [*np.searchsorted(codes, np.array(self.low, np.int64)).tolist(), len(codes)]
        codes, counts, large = codes.tolist(), counts.tolist(), []
        for k, box in enumerate(self.held):
            new = codes[cuts[k] : cuts[k + 1]]
            box.update(zip(new, map(add, map(box.get, new, repeat(0)), counts[cuts[k] : cuts[k + 1]]), strict=True))
            if len(box) > self.burst and self.low[k] not in self.whole:
                large.append(k)
        for k in reversed(large):
            self._burst(k)

    def _burst(self, k: int) -> None:
        """Parts a container at the border of words nearest its middle: first words, or, below one of them, second words."""
        keys = np.sort(np.fromiter(self.held[k], np.int64, len(self.held[k])))
        for shift in (2 * BITS, BITS):
            words = keys >> shift
            borders = np.flatnonzero(words[1:] != words[:-1]) + 1
            if len(borders):
                middle = borders[np.abs(borders - len(keys) // 2).argmin()]
                border = int(words[middle]) << shift
                box = self.held[k]
                above = {c: n for c, n in box.items() if c >= border}
                self.held[k : k + 1] = [{c: n for c, n in box.items() if c < border}, above]
                self.low.insert(k + 1, border)
                for at in (k + 1, k):
                    if len(self.held[at]) > self.burst:
                        self._burst(at)
                return
        self.whole.add(self.low[k])

    def spilled(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties the largest containers until at most ``least`` codes are held; each gives its codes and counts."""
        left = self.size()
        for k in sorted(range(len(self.held)), key=lambda k: -len(self.held[k])):
            box = self.held[k]
            if left <= least or not box:
                return
            self.held[k] = {}
            left -= len(box)
            yield np.fromiter(box, np.int64, len(box)), np.fromiter(box.values(), np.int64, len(box))


def language_mark(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class WordMarks:
    """Hashes of the words of a text."""

    def __init__(self) -> None:
        self.size, self.hasher = 0, None

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(raw) > self.size:
            self.size = max(len(raw), CHUNK + (CHUNK >> 4))
            self.hasher = Hasher(3, 0x9E3779B97F4A7C15, self.size)
        return self.hasher.of(self.hasher.sums(raw), starts, ends)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text of pieces that end with ``.`` start and end, and how many pieces end before each."""
    dot = raw == ord(".")
    gap = np.concatenate([[True], dot | (raw == ord(" ")), [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(dot), starts)


@dataclass(frozen=True)
class Filter:
    """Two-word phrases of each language, as two bits each of a field of bounded size."""

    bits: np.ndarray

    @staticmethod
    def spots(lang: np.uint64 | np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of phrases, from the marks of their language and words."""
        mixed = ((first ^ lang) * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        mask = np.uint64(size - 1)
        return mixed & mask, (mixed >> np.uint64(32)) & mask

    def has(self, lang: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        here = np.ones(len(first), bool)
        for spot in self.spots(np.uint64(lang), first, second, 64 * len(self.bits)):
            here &= (self.bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) != 0
        return here

    @classmethod
    def of(cls, pairs: DataFrame, most: int) -> Filter:
        """Of the two-word phrases (lang, phrase); the driver gets the field's blocks as bytes, whatever the number of phrases."""
        wanted = max(64, BITS_EACH * pairs.count())
        size = min(most, 1 << (wanted - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = WordMarks()
            for batch in batches:
                langs = np.array([language_mark(lang) for lang in batch.column(0).to_pylist()], np.uint64)
                # Words have neither spaces nor full stops.
                raw = np.frombuffer(" ".join(batch.column(1).to_pylist()).encode(), np.uint8)
                starts, ends, _ = word_spans(raw)
                words = marks.of(raw, starts, ends)
                spot = np.concatenate(cls.spots(langs, words[::2], words[1::2], size))
                bit = (np.uint64(1) << (spot & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "bits"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                at, bits = (batch.column(i).to_numpy() for i in range(2))
                block, order = at // BLOCK, np.argsort(at // BLOCK, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(at) else ():
                    field = held.setdefault(int(block[rows[0]]), np.zeros(BLOCK, np.int64))
                    np.bitwise_or.at(field, at[rows] % BLOCK, bits[rows])
            for block, field in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([field.tobytes()], pa.binary())], names=["block", "field"])

        spread = pairs.select("lang", "phrase").mapInArrow(run, "at long, bits long").repartition(F.expr(f"at div {BLOCK}"))
        bits = np.zeros(size // 64, np.uint64)
        for found in spread.mapInArrow(merged, "block long, field binary").collect():
            at = found["block"] * BLOCK
            bits[at : at + BLOCK] = np.frombuffer(found["field"], np.uint64)[: len(bits) - at]
        return cls(bits)


class Counter:
    """What a task counts: a trie for each language, over words that all of them share.

    ``sizes`` are the words of the phrases that are counted; of longer ones only those whose halves ``known`` has.
    """

    def __init__(self, sizes: Sequence[int], burst: int, held: int, known: Filter | None = None) -> None:
        self.sizes, self.words, self.burst, self.most, self.known = set(sizes), max(sizes), burst, held, known
        if known is not None and self.sizes != {WORDS}:
            raise ValueError(f"a filter tells phrases of {WORDS} words")
        self.marks = WordMarks()
        self.clear()

    def clear(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count(1).__next__, {b".": 0})
        self.tries: dict[str, Trie] = {}
        self.totals: dict[str, int] = {}

    def count(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Counts phrases of a text whose pieces end with ``.``; gives runs when it holds too much."""
        if self.known is not None:
            yield from self._count_known(lang, text)
            return
        at, carry = 0, np.empty(0, np.int64)
        while at < len(text):
            if self._full(lang):
                # Words get new numbers, so the last ones of the chunk before have to be looked up again.
                names = {n: w for w, n in self.ids.items()}
                last = [names[n] for n in carry.tolist()]
                yield from self.runs(0)
                self.clear()
                carry = np.array([self.ids[w] for w in last], np.int64)
            end = text.find(b" ", at + CHUNK)
            end = len(text) if end < 0 else end
            found = text[at:end].replace(b".", b" . ").split()
            fresh = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
            self._add(lang, np.concatenate([carry, fresh]), len(carry))
            carry = np.concatenate([carry, fresh])[-(self.words - 1) :] if self.words > 1 else carry
            at = end
            yield from self._spilled()

    def _full(self, lang: str) -> bool:
        return len(self.ids) > VOCABULARY or (lang not in self.tries and len(self.tries) >= LANGUAGES)

    def _spilled(self) -> Iterator[pa.RecordBatch]:
        if sum(t.size() for t in self.tries.values()) > self.most:
            yield from self.runs(self.most // 2)

    def _count_known(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Counts phrases of WORDS words whose halves ``known`` has; other words get no number."""
        at, end, mark = 0, 0, language_mark(lang)
        while end < len(text):
            if self._full(lang):
                yield from self.runs(0)
                self.clear()
            borders = [b for b in (text.find(c, end + CHUNK) for c in (b" ", b".")) if b >= 0]
            end = min(borders, default=len(text))
            raw = np.frombuffer(text, np.uint8, end - at, at)
            starts, ends, piece = word_spans(raw)
            if len(starts) >= WORDS:
                marks = self.marks.of(raw, starts, ends)
                half = piece[1:] == piece[:-1]
                pair = np.flatnonzero(half)
                half[pair] = self.known.has(mark, marks[pair], marks[pair + 1])
                first = np.flatnonzero(half[1:] & half[:-1])
                if len(first):
                    here = np.zeros(len(starts), bool)
                    for k in range(WORDS):
                        here[first + k] = True
                    spans = zip((starts[here] + at).tolist(), (ends[here] + at).tolist(), strict=True)
                    ids = np.zeros(len(starts), np.int64)
                    ids[here] = np.fromiter((self.ids[text[a:b]] for a, b in spans), np.int64, int(here.sum()))
                    codes = sum(ids[first + k] << (BITS * (WORDS - 1 - k)) for k in range(WORDS))
                    self.tries.setdefault(lang, Trie(self.burst)).add(*np.unique(codes, return_counts=True))
            # The next chunk begins with the last words of this one, which make no phrase by themselves.
            at = at + int(starts[-(WORDS - 1) :][0]) if len(starts) else end
            yield from self._spilled()

    def _add(self, lang: str, ids: np.ndarray, seen: int) -> None:
        """Counts the phrases that end in the words from ``seen`` on."""
        codes, phrase, inside = [], np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        for k in range(min(self.words, len(ids))):
            last = ids[k:]
            phrase, inside = phrase[: len(last)] | (last << (BITS * (WORDS - 1 - k))), inside[: len(last)] & (last > 0)
            if k + 1 in self.sizes:
                new = max(seen - k, 0)
                codes.append(phrase[new:][inside[new:]])
        if 1 in self.sizes and len(codes[0]):
            self.totals[lang] = self.totals.get(lang, 0) + len(codes[0])
        if any(map(len, codes)):
            trie = self.tries.setdefault(lang, Trie(self.burst))
            trie.add(*np.unique(np.concatenate(codes), return_counts=True))

    def runs(self, least: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, and the number of words since the last time as a phrase without words."""
        words = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        rank = np.empty(len(words), np.int64)
        rank[pc.array_sort_indices(words).to_numpy()] = np.arange(1, len(words) + 1)
        rank[0] = 0  # no word
        # Words that follow others, each after a space; no word is nothing.
        following = pc.binary_join_element_wise(pa.array([""] + [" "] * (len(words) - 1)), pc.if_else(pa.array(rank > 0), words, ""), "")
        mask = (1 << BITS) - 1
        if self.totals:
            yield self._batch(list(self.totals), [""] * len(self.totals), list(self.totals.values()))
            self.totals = {}
        left = {lang: trie.size() for lang, trie in self.tries.items()}
        share = least / max(1, sum(left.values()))
        for lang, trie in self.tries.items():
            for codes, counts in trie.spilled(int(left[lang] * share)):
                ids = [(codes >> (BITS * (WORDS - 1 - k))) & mask for k in range(WORDS)]
                order = np.argsort(sum(rank[i] << (BITS * (WORDS - 1 - k)) for k, i in enumerate(ids)))
                ids, counts = [i[order] for i in ids], counts[order]
                parts = [words.take(pa.array(ids[0])), *[following.take(pa.array(i)) for i in ids[1 : self.words]]]
                phrase = pc.binary_join_element_wise(*parts, "") if len(parts) > 1 else parts[0]
                yield self._batch(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int8))), phrase, counts)

    @staticmethod
    def _batch(lang, phrase, counts) -> pa.RecordBatch:
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


def phrase_runs(
    docs: DataFrame, sizes: Sequence[int] = (1, 2), burst: int = BURST, held: int = HELD, known: Filter | None = None
) -> DataFrame:
    """(lang, phrase, n) of phrases of some numbers of words: sorted runs of each task.

    With phrases of one word, the phrase without words counts all words.
    """
    shared = sent(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, texts, lengths = Counter(sizes, burst, held, shared()), {}, {}

        def counted(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                lengths.pop(lang)
                yield from counter.count(lang, b".".join(texts.pop(lang)))

        for part in pieces(batches):
            for text, lang in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text.translate(_LOWER))
                lengths[lang] = lengths.get(lang, 0) + len(text)
            if len(lengths) > LANGUAGES or sum(lengths.values()) >= CHUNK:
                yield from counted(list(texts))
        yield from counted(list(texts))
        yield from counter.runs(0)

    text, lang = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")
    return docs.select(text, lang).mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(runs: DataFrame) -> DataFrame:
    """(lang, phrase, n): the runs merged, each prefix partition by itself."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    cell = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2), salt), F.lit(CELLS)).cast("int")
    dealt = runs.withColumn("cell", cell).repartition("cell")
    return dealt.groupBy("cell", "lang", "phrase").agg(F.sum("n").alias("n")).drop("cell")


def _words(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame,
    least: int = 10,
    share: int = 50,
    words: int = WORDS,
    burst: int = BURST,
    held: int = HELD,
    bits: int = BITS_MOST,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that stay.

    ``share``: a candidate goes if a longer one around it occurs at least so many times in a hundred of its own.
    """
    if not 2 <= words <= WORDS:
        raise ValueError(f"phrases have 2 to {WORDS} words")
    counts = phrase_counts(phrase_runs(docs, (1, 2), burst, held))
    frequent = stored(counts.where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")
    if words == WORDS:
        known = Filter.of(frequent.where(F.col("phrase").contains(" ")), bits)
        longer = phrase_counts(phrase_runs(docs, (WORDS,), burst, held, known)).where(F.col("n") >= least)
        frequent = frequent.unionByName(stored(longer, "long-phrases"))
    known = frequent.where("phrase <> ''")
    totals = frequent.where("phrase = ''").select("lang", F.col("n").alias("total"))
    long = known.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") > 1)
    size = F.size("words")
    cuts = long.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, size - F.col("k")).alias("rest"))
    firsts = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    score = F.expr("cast(cast(1000000 as decimal(7,0)) * a * a as decimal(38,0)) div cast(l * r as decimal(38,0))")
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    scored = scored.withColumns({f"{c}_": F.col(c) for c in wide} | wide).withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", F.col("a_").alias("a"), F.col("l_").alias("l"), F.col("r_").alias("r"))).alias("best"))
    # Phrases of two words and more inside longer ones, each with the count of the most frequent of these.
    inner = long.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("some"))
    inner = inner.select("lang", "a", "words", "some", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("some") + 1)).alias("first"))
    around = inner.groupBy("lang", _words(F.col("first"), F.col("some")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * best.a"))
    found = kept.join(totals, "lang")
    return found.select("lang", "phrase", "best.a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def top_collocations(docs: DataFrame, most: int = 2000, **options: int) -> DataFrame:
    """The first ``most`` of each language, with their ``rank`` from 1.

    A language's phrases are first ranked in SALTS parts, so the last window of a language gets ``most`` of each.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = collocations(docs, **options).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
