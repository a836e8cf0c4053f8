"""Chat formatting, vector codes and collocations against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from inktally.llm import chat_format, collocations, queries, vector_codes
from tests.llm.helpers import EDGES, prose, table


@pytest.fixture(scope="module")
def vocabulary():
    return queries.tokenizer_file()


TURNS = "conv_id long, turn long, role string, text string, place long, ids string, whole int, nth int, tie string"
MARKED = [
    "</s>[INST] ok [/INST]", "<s><s>", "[\\INST] and [\\\\INST]", "<|endoftext|> <\\|endoftext|>", "[INS", "T]", "\\", "\\\\", "<", "</s", ">",
    "  two\n\n lines \t", "\n", "é 😀 日本語 ́x", "\x00\x1c", " ", "assistant", "[[INST]]", "<</s>>", "[/INST\\]",
]


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", 2, 3, "t") for r in rows], TURNS)


def _brute_chat(rows):
    """Turns in order; the length of each is found by putting backslashes in one at a time."""
    import re

    out, by_id = [], {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_id.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        chars = sum(20 + len(r) + len(t) + sum(len(re.findall(p, x)) for x in (r, t) for p in (r"<\\*(?:s>|/s>|\|endoftext\|>)", r"\[\\*/?INST\]")) for _, _, r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
        out.append((conv, len(turns), digest[0], len(learned), digest[1], chars))
    return sorted(out, key=repr)


def _told(spark, rows, vocabulary):
    made = chat_format.formatted(_conversations(spark, rows), vocabulary)
    return made, sorted([tuple(r) for r in chat_format.read_back(made, vocabulary).collect()], key=repr)


@pytest.mark.parametrize("chars,turns", [(1 << 20, 1 << 14), (60, 1 << 14), (1 << 20, 3)])
def test_conversations(spark, vocabulary, monkeypatch, chars, turns):
    monkeypatch.setattr(chat_format, "PART_CHARS", chars)
    monkeypatch.setattr(chat_format, "PART_TURNS", turns)
    rng, rows = random.Random(1), []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice([*MARKED, prose(conv, 6), "word "]) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "[INST]", "a\nb"]), text))
    rows += [(100 + i, 0, "assistant", t) for i, t in enumerate(MARKED)]
    rows += [(200, None, "user", "no turn"), (200, 1, None, None), (None, 2, "assistant", "nowhere"), (None, 5, "assistant", None)]
    made, found = _told(spark, rows, vocabulary)
    assert found == _brute_chat(rows)
    assert _told(spark, [], vocabulary)[1] == []
    if chars == 1 << 20 and turns == 1 << 14:
        # The tokens are those that the library gives for the whole text, and they give it back.
        library = chat_format.encoder(vocabulary, chat_format.Template().marks)
        for r in made.collect():
            assert r.ids == library.encode(r.text, add_special_tokens=False).ids
            assert library.decode(r.ids, skip_special_tokens=False) == r.text


def test_ties_and_equal_rows(spark, vocabulary):
    """20,000 equal rows in one turn, and a turn with two texts, whose order is that of a hash but always the same."""
    same = _conversations(spark, [(1, 0, "assistant", "ab")]).crossJoin(spark.range(20_000).selectExpr("id as copy")).drop("copy")
    made = chat_format.formatted(same.repartition(8), vocabulary)
    row = chat_format.read_back(made, vocabulary).collect()
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in row] == [(20_000, 40_000, hashlib.sha256(b"ab" * 20_000).hexdigest())]
    rows = [(7, 1, "user", "x"), (7, 1, "user", "y"), (7, 1, "user", "z")]
    assert _told(spark, rows, vocabulary)[1] == _told(spark, rows[::-1], vocabulary)[1]


def test_token_ranges():
    offsets = np.array([(0, 3), (3, 5), (5, 6), (5, 6), (6, 9)])
    spans = np.array([(0, 0), (3, 6), (4, 4), (5, 6), (8, 9)])
    for (start, end), (first, last) in zip(spans.tolist(), chat_format.token_ranges(spans, offsets).tolist(), strict=True):
        if start < end:
            assert list(range(first, last)) == [i for i, (a, b) in enumerate(offsets.tolist()) if a < end and b > start]


def test_a_very_long_turn(spark, vocabulary):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "[INST] é " * 200_000), (1, 2, "user", "x")]
    assert _told(spark, rows, vocabulary)[1] == _brute_chat(rows)


def _brute_codes(rows, parts, entries, rounds, scale):
    import math

    kept = [(k, [math.floor(scale * float(np.float32(x))) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), i) for i, c in enumerate(book))

    for turn in range(rounds + 1):
        at = [[best(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for _, v in kept]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p * width : (p + 1) * width] for (_, v), a in zip(kept, at) if a[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted([(k, [i for _, i in a], sum(d for d, _ in a)) for (k, _), a in zip(kept, at)], key=repr), hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, row long, part int, code string"


def _vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 5, 6, "c") for k, v in rows], VECTORS)


@pytest.mark.parametrize("buckets,entries", [(1, 8), (6, 8), (5, 300)])
def test_codes(spark, buckets, entries):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 8).astype(np.float32)]) for i in rng.permutation(120).tolist()]
    rows += [(500 + i, rows[0][1]) for i in range(30)]  # a third of what remains at one entry
    rows += [(3, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (9, None), (10, [1.0, None] * 4), (11, [float("nan")] * 8), (12, [float("-inf")] * 8)]
    found, books = vector_codes.coded(_vectors(spark, rows), parts=4, entries=entries, rounds=3, buckets=buckets)
    mine = sorted([(r.vec_id, r.code, r.error) for r in found.collect()], key=repr)
    want, digest = _brute_codes(rows, 4, entries, 3, 1024)
    assert mine == want and books.digest() == digest
    assert set(found.columns) == set(VECTORS.replace(",", "").split()[::2]) | {"error"}


def test_codes_of_few_odd_and_no_vectors(spark):
    none, books = vector_codes.coded(_vectors(spark, []))
    assert none.count() == 0 and books.entries == []
    assert vector_codes.coded(_vectors(spark, [(1, None)]))[0].count() == 0
    empty, _ = vector_codes.coded(_vectors(spark, [(1, []), (2, [])]), buckets=2)
    assert [(r.code, r.error) for r in empty.collect()] == [([0] * 4, 0)] * 2
    for odd in ([(1, [0.0] * 4), (2, [0.0] * 8)], [(1, [0.0] * 6)]):
        with pytest.raises(ValueError):
            vector_codes.coded(_vectors(spark, odd))
    for scale in (1e5, 4e5):  # beyond what doubles, and what 64 bits hold between
        large = [(i, [float(np.float32(x * scale)) for x in np.random.default_rng(i).uniform(-3, 3, 4)]) for i in range(20)]
        found, books = vector_codes.coded(_vectors(spark, large), entries=4, rounds=2, buckets=2)
        mine = sorted([(r.vec_id, r.code, r.error) for r in found.collect()], key=repr)
        assert (mine, books.digest()) == _brute_codes(large, 4, 4, 2, 1024)


def test_members_stay_where_they_are(spark):
    """Sums need no shuffle of members, and what migrates is what changed its entry, less in each round."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(600)]
    kept = _vectors(spark, rows).selectExpr("vec_id as key", "transform(embedding, x -> floor(1024 * x)) as values", "vec_id as row")
    members = vector_codes.Members(spark, 6)
    books = vector_codes.first_books(kept, 4, 16)
    cut = [f"slice(values, {2 * p + 1}, 2)" for p in range(4)]
    members.start(kept.selectExpr("row", f"posexplode(array({', '.join(cut)})) as (position, part)"), books)
    plan = members.sums(2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for _ in range(4):
        books = members.updated(books)
        members.move(books)
        assert members.resident().count() == 2400
    assert 0 < members.moved[-1] < members.moved[0] < 2400
    members.remove()


def _brute_phrases(docs, least=10, share=50):
    import re

    counts, out = {}, []
    for _, text, lang in docs:
        mine = counts.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                mine.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            score, k = min((Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in long.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found), 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("burst,held,chunk,vocabulary,bits", [(1 << 14, 1 << 20, 1 << 20, 1 << 19, 1 << 20), (7, 60, 40, 1 << 19, 64), (3, 500, 97, 30, 512)])
def test_collocations(spark, monkeypatch, burst, held, chunk, vocabulary, bits):
    """Small containers, spills, chunks, vocabularies and filters that are full change nothing."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "VOCABULARY", vocabulary)
    monkeypatch.setattr(collocations, "LANGUAGES", 2 if chunk < 90 else 64)
    rng, known = random.Random(4), "a b c d é ß日 don't \x01 x-y q\x1cr NEW York".split(" ")
    docs = [(i, t, None) for i, t in EDGES]
    for i in range(150):
        words = [rng.choice(known[: rng.randint(2, len(known))]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "\x0b", ", ", "  "]) for w in words)
        docs.append((i, text + " new york city, New York city", rng.choice(["aa", "bb", "cc", None, "und"])))
    found = collocations.top_collocations(table(spark, docs).repartition(3), burst=burst, held=held, bits=bits).collect()
    mine = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)
    assert mine == _brute_phrases(docs) and len(mine) > 60


def test_collocations_of_nothing(spark):
    assert collocations.top_collocations(table(spark, [])).count() == 0
    assert collocations.top_collocations(table(spark, [(1, None), (2, " . ,")])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(table(spark, []), words=4)


def test_a_trie_bursts_between_words_and_spills_whole_subtrees():
    rng = np.random.default_rng(5)
    trie, want = collocations.Trie(50), Counter()
    for _ in range(30):
        ids = rng.integers(1, 12, (200, 3)) * (rng.random((200, 3)) < [1, 0.8, 0.6])
        ids[:, 2] *= ids[:, 1] > 0
        codes = (ids[:, 0] << 42) | (ids[:, 1] << 21) | ids[:, 2]
        want.update(codes.tolist())
        trie.add(*np.unique(codes, return_counts=True))
    assert len(trie.held) > 10 and trie.low == sorted(set(trie.low))
    assert all(low <= c for low, box in zip(trie.low, trie.held) for c in box)
    assert all(len(box) <= 50 or low in trie.whole for low, box in zip(trie.low, trie.held))
    assert {c: n for box in trie.held for c, n in box.items()} == want
    some = [dict(zip(c.tolist(), n.tolist())) for c, n in trie.spilled(trie.size() // 2)]
    assert trie.size() <= len(want) // 2 and sum(map(len, some)) + trie.size() == len(want)
    assert {c for s in some for c in s}.isdisjoint(c for box in trie.held for c in box)


def test_products_beyond_64_bits(spark):
    """Scores of phrases that occur some thousand million times, given as counts."""
    rows = [("en", "", 9 * 10**12), ("en", "x", 4 * 10**12), ("en", "y", 3 * 10**12 + 1), ("en", "x y", 3 * 10**12)]
    runs = spark.createDataFrame(rows, "lang string, phrase string, n long")
    before = collocations.phrase_runs
    collocations.phrase_runs = lambda docs, sizes, *a: runs.where("phrase not like '% % %'") if 1 in sizes else runs.limit(0)
    try:
        (row,) = collocations.top_collocations(table(spark, [])).collect()
    finally:
        collocations.phrase_runs = before
    assert (row.a, row.l, row.r, row.n) == (3 * 10**12, 4 * 10**12, 3 * 10**12 + 1, 9 * 10**12)
    assert row.score == 10**6 * row.a * row.a // (row.l * row.r)


def test_only_words_of_phrases_with_frequent_halves_get_numbers(monkeypatch):
    """Triples whose halves are known are counted, over the borders of chunks too; other words are not numbered."""
    monkeypatch.setattr(collocations, "CHUNK", 300)
    rare = [f"w{i}" for i in range(400)]
    words = [w for i in range(400) for w in (rare[i], *(["ab", "\u00e9", "cd"] if i % 2 else ["ab."]), *("x y z .".split() if i % 5 == 0 else []))]
    text = " ".join(words).encode()
    at, bits = np.frombuffer("ab \u00e9 \u00e9 cd x y".encode(), np.uint8), np.zeros(64, np.uint64)
    starts, ends, _ = collocations.word_spans(at)
    marks = collocations.WordMarks().of(at, starts, ends)
    for spot in collocations.Filter.spots(np.uint64(collocations.language_mark("en")), marks[::2], marks[1::2], 64 * 64):
        np.bitwise_or.at(bits, spot >> np.uint64(6), np.uint64(1) << (spot & np.uint64(63)))
    for known, least in ((collocations.Filter(bits), 200), (collocations.Filter(~np.zeros(1, np.uint64)), 0)):
        counter = collocations.Counter((3,), 1000, 10_000, known)
        runs = [*counter.count("en", text)]
        numbered = len(counter.ids)
        found = Counter()
        for run in [*runs, *counter.runs(0)]:
            for lang, phrase, n in zip(*[c.to_pylist() for c in run.columns], strict=True):
                assert lang == "en"
                found[phrase] += n
        pieces = [p.split() for p in text.decode().split(".")]
        want = Counter(" ".join(p[i : i + 3]) for p in pieces for i in range(len(p) - 2))
        if least:
            assert found["ab \u00e9 cd"] == want["ab \u00e9 cd"] == least and numbered < 100
            assert all(want[p] == n for p, n in found.items())
        else:
            assert found == want


@pytest.mark.parametrize("block", [1 << 13, 4])
def test_the_driver_gets_the_filter_in_blocks(spark, monkeypatch, block):
    """A row for each block, not for each word of the field; a field smaller than a block, and one of many."""
    monkeypatch.setattr(collocations, "BLOCK", block, raising=False)
    got, frame = [], type(spark.range(0))
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, before=getattr(frame, name): got.append(before(self)) or got[-1])
    pairs = [("en" if i % 3 else "de", f"a{i} b{i % 50}") for i in range(700)]
    for some in (pairs, pairs[:3], []):
        got.clear()
        known = collocations.Filter.of(spark.createDataFrame(some, "lang string, phrase string").repartition(3), 1 << 14)
        assert sum(map(len, got)) <= -(-len(known.bits) // block)
        want = np.zeros(len(known.bits), np.uint64)
        for lang, phrase in some:
            text = np.frombuffer(phrase.encode(), np.uint8)
            marks = collocations.WordMarks().of(text, *collocations.word_spans(text)[:2])
            for spot in collocations.Filter.spots(np.uint64(collocations.language_mark(lang)), marks[:1], marks[1:], 64 * len(want)):
                want[spot >> np.uint64(6)] |= np.uint64(1) << (spot & np.uint64(63))
        assert (known.bits == want).all() and known.bits.any() == bool(some)
