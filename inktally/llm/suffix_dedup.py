"""Passages of a length and more that stand earlier in the corpus, by run-length indexes over what repeats.

1. Every window of ``length`` bytes is dealt to its anchor, the place in it where the hash of GRAM bytes is
   smallest; equal windows have equal anchors. Neighbouring windows share an anchor, so a text becomes a list of
   segments: an anchor's hash, the windows it has, and a hash of their bytes.
2. Segments meet by anchor. One that is equal to an earlier one has only repeated windows. One whose anchor occurs
   nowhere else has none. Of the rest, where segments of an anchor differ, the distinct ones go on with their bytes.
3. These are dealt into groups of bounded size by anchor. A group's segments make one text, in the order of the
   corpus; its Burrows-Wheeler transform is run-compressed, and only at the runs' ends the suffixes and the lengths
   they share are sampled. Streaming through the text, the samples give each place's matching statistics: its
   predecessor among the suffixes, and how far both agree. Places that agree for ``length`` bytes are chained; all
   but a chain's first are repeated windows.
4. Anchors with more distinct segments than a group may have (LIMIT) are resolved window by window instead, by
   hashes that are counted before they are shuffled. The result is the same.

Hashes have 64 bits and two are compared everywhere, so an accidental match is as unlikely as one of 128 bits.

Defined results: a null text is empty; null doc_ids come after all others; rows that share a doc_id, or have
none, are separate documents in the order of a hash of their texts, and equal rows among them are one document,
returned as often as given; no rows give no rows. Extra columns pass through; of the columns named like a result,
the result stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.llm.common import LAST_ID, bare_name, pieces, stored, with_results

#: Bytes that choose an anchor.
GRAM = 32
#: Windows hashed at once; segments sorted at once by a task before they are shuffled.
CHUNK, HELD = 1 << 19, 1 << 20
#: Bytes of a group's text, about; distinct segments of an anchor that a group may have.
GROUP_BYTES, LIMIT = 1 << 21, 1 << 15
#: Layout of a place: the first window, and 7 bits that count further ones.
SPAN_BITS = 7
_U = np.uint64


class Hasher:
    """Hashes of all substrings of one length, from prefix sums modulo 2**64."""

    def __init__(self, seed: int, base: int, size: int) -> None:
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=_U)
        self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(base))]))
        self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(pow(base, -1, 1 << 64)))]))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, _U)
        np.cumsum(self.values[raw] * self.down[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (sums[ends] - sums[starts]) * self.up[starts]
        x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(32))


def hashers(length: int) -> tuple[Hasher, Hasher]:
    return Hasher(1, 0x9E3779B97F4A7C15, CHUNK + length), Hasher(2, 0xC2B2AE3D27D4EB4F, CHUNK + length)


def segments(raw: np.ndarray, length: int, both: tuple[Hasher, Hasher]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, hash, first window, last window) of the segments of a text."""
    gram = min(GRAM, length)
    span = length - gram + 1
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        windows = len(part) - length + 1
        one, two = (h.sums(part) for h in both)
        place = np.arange(len(part) - gram + 1)
        gram_hash = both[0].of(one, place, place + gram)
        # Smallest of each span of places: up to the next block border, and from the one before.
        low = (gram_hash & ~_U(0xFFFFFF)) | place.astype(_U)
        blocks = np.concatenate([low, np.full(-len(low) % span, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _U(0xFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], windows) - 1
        whole = both[1].of(two, first, last + length) + (last - first).astype(_U)
        yield gram_hash[anchor[first].astype(np.int64)], whole, at + first, at + last


def _identity() -> tuple[Column, Column]:
    """doc and row: the order of documents; row, the whole hash of the text, tells rows of one doc_id or of none apart."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), mark.alias("row")


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """(key, hash, doc, row, place, known) of all segments of (doc, row, text).

    Of equal segments that a task meets, only the first is dealt by its anchor. The others are known to repeat;
    they get a key of their own, so that they are spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, count = hashers(length), [], 0

        def sorted_out() -> pa.RecordBatch:
            key, whole, doc, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, row, doc, whole, key))
            key, whole, doc, row, place = key[order], whole[order], doc[order], row[order], place[order]
            # Equal rows give a place twice; it counts once.
            new = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            once = np.concatenate([[True], new])
            key, whole, doc, row, place = key[once], whole[once], doc[once], row[once], place[once]
            known = np.concatenate([[False], (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])])
            key = np.where(known, doc.astype(_U) * _U(0x9E3779B97F4A7C15) + row.astype(_U) + place.astype(_U), key)
            columns = [pa.array(c) for c in (key.view(np.int64), whole.view(np.int64), doc, row, place, known)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["key", "hash", "doc", "row", "place", "known"])

        for part in pieces(batches):
            columns = [part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()]
            for doc, row, text in zip(*columns, strict=True):
                raw = np.frombuffer(text or b"", np.uint8)
                for key, whole, first, last in segments(raw, length, both):
                    place = (first << SPAN_BITS) | (last - first)
                    held.append((key, whole, np.full(len(key), doc), np.full(len(key), row), place))
                    count += len(key)
                if count >= HELD:
                    yield sorted_out()
                    count = 0
        if held:
            yield sorted_out()

    return texts.select("doc", "row", "text").mapInArrow(run, "key long, hash long, doc long, row long, place long, known boolean")


def judged(found: DataFrame) -> DataFrame:
    """(doc, row, place, key, peers): segments with repeated windows, or that may have some.

    ``peers`` is null for those that are repeated as a whole; else it counts the anchor's distinct segments.
    """
    dealt = found.repartition("key")
    same = Window.partitionBy("key", "hash").orderBy("doc", "row", "place")
    anchor = Window.partitionBy("key")
    numbered = dealt.withColumn("nth", F.row_number().over(same)).withColumn("rank", F.rank().over(same))
    # Of a place that equal rows give several times, one stands for all.
    numbered = numbered.where("known or rank > 1 or nth = 1")
    own = numbered.withColumn("repeated", F.col("known") | (F.col("rank") > 1))
    counted = own.withColumn("peers", F.sum(F.when(F.col("repeated"), 0).otherwise(1)).over(anchor))
    peers = F.when(~F.col("repeated"), F.col("peers"))
    return counted.where("repeated or peers > 1").select("doc", "row", "place", "key", peers.alias("peers"))


class RunIndex:
    """A run-length compressed index of a text of whole numbers, each place's suffix being distinct.

    Kept are, for the head of each run of the Burrows-Wheeler transform, its suffix, the suffix at the end of the run
    before it, and how many symbols the two share; for the rest of a run, both only move on by one.
    """

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], -1)
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        at = order[heads]
        end_before = np.where(heads > 0, order[heads - 1], -1)
        shared = _agreement(text, at, end_before)
        by_place = np.argsort(at)
        self.runs = len(heads)
        self.at, self.end_before, self.shared = at[by_place], end_before[by_place], shared[by_place]

    def statistics(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place, the suffix before its own in their order, and how many symbols they share."""
        sample = np.searchsorted(self.at, place, "right") - 1
        moved = place - self.at[sample]
        return self.end_before[sample] + moved, self.shared[sample] - moved


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by doubling the compared length.

    The first comparison is of as many symbols as a whole number holds. Each further one is of the places that are not
    told apart yet.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    symbol = text.astype(np.int64) - int(text.min()) + 1
    if int(symbol.max()).bit_length() > 20:
        symbol = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(symbol.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key[: max(n - k, 0)] |= symbol[k:] << (bits * (step - 1 - k))
    order = np.argsort(key)
    key, slots, found, rank = key[order], np.arange(n), order, np.empty(n, np.int64)
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[found] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        open_ = ~(new & np.append(new[1:], True))
        slots = slots[open_]
        if not len(slots):
            return order
        found = order[slots]
        after = found + step
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[found] * (n + 1) + following
        by_key = np.argsort(key)
        found, key = found[by_key], key[by_key]
        order[slots] = found
        step *= 2


def _agreement(text: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at two lists of places share; -1 stands for none."""
    shared, open_ = np.zeros(len(one), np.int64), np.flatnonzero(other >= 0)
    length, n = 0, len(text)
    while len(open_):
        a, b = one[open_] + length, other[open_] + length
        fits = (a < n) & (b < n)
        open_ = open_[fits][text[a[fits]] == text[b[fits]]]
        length += 1
        shared[open_] = length
    return shared


def repeated_places(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each text, the places where ``length`` bytes begin that begin earlier too, in it or in a text before it."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    text = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + len(texts)
    text[ends] = np.arange(len(texts))  # a border of its own after each text
    index, place = RunIndex(text), np.arange(len(text))
    before, shared = index.statistics(place)
    root = np.where(shared >= length, before, place)
    while True:  # chains to their first suffix
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    first = np.full(len(text), len(text))
    np.minimum.at(first, root, place)
    repeated = np.flatnonzero(first[root] < place)
    cuts = np.searchsorted(repeated, ends)
    return [found - start for found, start in zip(np.split(repeated, cuts[:-1]), ends - sizes + 1, strict=True)]


def _as_places(windows: np.ndarray) -> np.ndarray:
    """Windows of a text as places: neighbours together, as far as a place can count."""
    most = (1 << SPAN_BITS) - 1
    if not len(windows):
        return windows
    first = np.flatnonzero(np.concatenate([[True], np.diff(windows) != 1]))
    out = []
    for a, b in zip(first, [*first[1:], len(windows)], strict=True):
        for lo in range(int(windows[a]), int(windows[b - 1]) + 1, most + 1):
            out.append((lo << SPAN_BITS) | min(most, int(windows[b - 1]) - lo))
    return np.array(out, np.int64)


def _indexed(cut: DataFrame, length: int, groups: int) -> DataFrame:
    """(doc, row, place) of repeated windows of the segments (key, doc, row, place, body), a group at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc", "row", "place"])
        found = repeated_places(group["body"].tolist(), length)
        places = [_as_places(w + (p >> SPAN_BITS)) for w, p in zip(found, group["place"], strict=True)]
        each = [len(p) for p in places]
        docs, rows = np.repeat(group["doc"].to_numpy(), each), np.repeat(group["row"].to_numpy(), each)
        return pd.DataFrame({"doc": docs, "row": rows, "place": np.concatenate([*places, np.empty(0, np.int64)])})

    dealt = cut.select(F.pmod("key", F.lit(groups)).alias("group"), "doc", "row", "place", "body")
    return dealt.groupBy("group").applyInPandas(run, "doc long, row long, place long")


def _window_by_window(cut: DataFrame, length: int) -> DataFrame:
    """The same by hashes of single windows, for anchors with very many segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = hashers(length)
        for part in pieces(batches):
            columns = []
            for doc, row, place, body in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                raw = np.frombuffer(body, np.uint8)
                starts = np.arange(len(raw) - length + 1)
                hashes = [h.of(h.sums(raw), starts, starts + length).view(np.int64) for h in both]
                at = ((place >> SPAN_BITS) + starts) << SPAN_BITS
                columns.append((*hashes, np.full(len(starts), doc), np.full(len(starts), row), at))
            if columns:
                whole = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays(whole, names=["h1", "h2", "doc", "row", "place"])

    windows = cut.select("doc", "row", "place", "body").mapInArrow(run, "h1 long, h2 long, doc long, row long, place long")
    here = F.struct("doc", "row", "place")
    firsts = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last")
    return windows.join(firsts, ["h1", "h2"]).where(here > F.col("first")).select("doc", "row", "place")


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``packed``, the text compressed, in place of ``text``, since it is shuffled."""
    kept = [f for f in texts.schema.fields if f.name != "text"]
    out = T.StructType([*kept, T.StructField("packed", T.BinaryType())])
    at, spots = texts.columns.index("text"), [i for i, c in enumerate(texts.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in pieces(batches):
            packed = [squeeze(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()]
            columns = [*[part.column(i) for i in spots], pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return texts.mapInArrow(run, out)


def _cut(packed: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """(key, doc, row, place, body, peers) of the segments ``mixed``."""
    pieces_of = F.collect_list(F.struct("key", "place", "peers")).alias("wanted")
    wanted = mixed.groupBy("doc", "row").agg(pieces_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "row", "place", "body", "peers"]
        for part in pieces(batches):
            open_, out = zstandard.ZstdDecompressor().decompress, []
            for doc, row, text, wanted in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                raw = open_(text)
                for w in wanted:
                    first = w["place"] >> SPAN_BITS
                    end = first + (w["place"] & ((1 << SPAN_BITS) - 1)) + length
                    out.append((w["key"], doc, row, w["place"], raw[first:end], w["peers"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    once = packed.select("doc", "row", "packed").dropDuplicates(["doc", "row"])  # equal rows are one text
    texts = once.join(wanted, ["doc", "row"]).select("doc", "row", "packed", "wanted")
    return texts.mapInArrow(run, "key long, doc long, row long, place long, body binary, peers long")


def _kept(both: DataFrame, length: int) -> DataFrame:
    """The rows of ``both`` (given, packed, places) with the bytes that stay and the runs that go."""
    kinds = "n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:bigint,end:bigint>>"
    out = T.StructType([both.schema["given"], *T._parse_datatype_string(kinds).fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(raw: bytes, places: list[int] | None) -> tuple[int, int, int, bytes, list]:
        if not places:
            return len(raw), 0, 0, raw, []
        place = np.sort(np.array(places, np.int64))
        first = place >> SPAN_BITS
        end = np.maximum.accumulate(first + (place & ((1 << SPAN_BITS) - 1)) + length)
        new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
        starts, ends = first[new], end[np.append(new[1:], len(end)) - 1]
        left = [raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True)]
        removed = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return len(raw), int((ends - starts).sum()), len(starts), b"".join(left), removed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            open_ = zstandard.ZstdDecompressor().decompress
            rows = [one(open_(t), p) for t, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), span]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=out.fieldNames())

    return both.select("given", "packed", "places").mapInArrow(run, out)


def without_repeats(
    docs: DataFrame, length: int = 100, limit: int = LIMIT, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """The documents, with what is left of each text in place of it.

    ``kept`` holds the bytes that stay (they may end inside a character), ``removed`` the runs of bytes that go,
    beside ``n_bytes``, ``n_removed`` and ``n_spans``.
    """
    doc, row = _identity()
    texts = docs.select(doc, row, "text")
    found = stored(judged(anchored(texts, length)), "segments")
    mixed = found.where("peers is not null")
    groups = max(1, -(-mixed.count() * (length + 40) // group_bytes))
    cut = stored(_cut(_packed(texts), mixed, length), "bodies")
    marks = [
        found.where("peers is null").select("doc", "row", "place"),
        _indexed(cut.where(F.col("peers") <= limit), length, groups),
        _window_by_window(cut.where(F.col("peers") > limit), length),
    ]
    marked = marks[0].unionByName(marks[1]).unionByName(marks[2])
    places = marked.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    rest = [c for c in docs.columns if c != "text"]
    given = F.struct(*[F.col(bare_name(c)) for c in rest]).alias("given")
    both = _packed(docs.select(given, doc, row, "text")).join(places, ["doc", "row"], "left")
    results = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
    return with_results(_kept(both, length), rest, **{c: c for c in results})
