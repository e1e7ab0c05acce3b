"""Operators on documents against brute force, round trips, held-out accuracy, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from veltra.llm import chaining, jaccard, media, mixing, quality, sentencepiece_bpe, suffix_dedup, toxicity
from veltra.llm._util import binary_parts, mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, lo long, spans string, n long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def corpus():
    """Exact and near copies, shared passages, repeats in a text, empty, null and long texts, repeated rows, null ids."""
    rnd = random.Random(3)
    lexicon = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(lexicon) for _ in range(n))
    base, passage = text(200), text(70)
    texts = [base, base, base.upper(), base + " tail", "x " + base[:-30], None, "", "  \n\t ", "one", "One", "two words", text(4000), text(30) + "\n" + passage + " " + text(40), text(60) + " " + passage, passage + " " + passage]
    near = base.split()
    for i in range(12):
        copy = list(near)
        copy[7 + 10 * i] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [text(rnd.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", "s2", None)[i % 4] if i > 20 else "s0", 0 if t is None else len(t), 1, 2, "clash", 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, text(60), "en", "s1", 1, 1, 1, "x", 1), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_components(docs, k, percent):
    rows = [(r.doc_id, shingles(r.text, k)) for r in docs.collect()]
    label = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    want = sorted(map(repr, ((d, len(s), least[x] if s else d) for (d, s), x in zip(rows, label))))
    assert sorted(map(repr, (tuple(r) for r in jaccard.join(docs, k=k, percent=percent).select("doc_id", "n_shingles", "component_id").collect()))) == want


def test_jaccard_opens_groups_by_their_bound(docs, monkeypatch):
    """With chunks of two nodes, links must be found between chunks and groups."""
    monkeypatch.setattr(jaccard, "CHUNK_NODES", 2)
    found = {r.doc_id: r.component_id for r in jaccard.join(docs.where("doc_id is not null"), k=3, percent=90).collect()}
    monkeypatch.undo()
    assert found == {r.doc_id: r.component_id for r in jaccard.join(docs.where("doc_id is not null"), k=3, percent=90).collect()}


def test_overlap_product():
    rnd = np.random.default_rng(1)
    group = [np.unique(rnd.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 400, 6000)]
    assert (jaccard.overlaps(group) == [[len(np.intersect1d(a, b)) if i != j else len(np.intersect1d(a, np.unique(np.concatenate([g for m, g in enumerate(group) if m != i])))) for j, b in enumerate(group)] for i, a in enumerate(group)])[~np.eye(4, dtype=bool)].all()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece_matches_the_library(docs, library):
    want = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in sentencepiece_bpe.digests(docs).collect()) == want


def test_sentencepiece_round_trip_and_odd_texts(spark, library):
    rnd = random.Random(5)
    odd = ["", " lead", "  two", "trail  ", "a\x00b", "▁x ▁ ▁▁", "😀 x😀", "<s></s> <unk>", "\n\n\t", "aaaa" * 300, " " * 50, "é 한 字"]
    odd += ["".join(rnd.choice("ab c\nthe ▁é字😀<0x>") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    codec = sentencepiece_bpe._codec(sentencepiece_bpe._model(None))
    ids, offs = codec.encode(*binary_parts(pa.array(odd)))
    for i, text in enumerate(odd):
        want = library.encode(text, add_eos=True)
        assert ids[offs[i] : offs[i + 1]].tolist() == want
        assert codec.decode(np.array(want)).decode() == library.decode(want)
    some = [rnd.randrange(32000) for _ in range(3000)]
    for i in range(0, 3000, 7):
        assert codec.decode(np.array(some[i : i + 7])).decode() == library.decode(some[i : i + 7])
    df = spark.createDataFrame([(1, "round trip  text\n", "clash")], "doc_id long, text string, ids string")
    out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df)).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "round trip  text\n")]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_bpe.PieceCodec(b"\x12\x02\x18\x01")


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length, most", [(400, 1024), (60, 1024), (60, 2)])
def test_suffix_dedup(docs, monkeypatch, length, most):
    """most=2 sends every frequent minimiser through both ways of splitting it."""
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, removed([r.text for r in rows], length)))
    got = suffix_dedup.dedup(docs, length=length).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


def test_suffix_dedup_cuts_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcd ") for _ in range(5000))
    texts = [base, base[700:2900] + "zz" + base[4000:], "q" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(df, length=100).collect()}
    assert got == dict(enumerate(removed(texts, 100)))


def test_interval_expansion():
    rnd = random.Random(0)
    base = bytes(rnd.choice(b"ab ") for _ in range(2000))
    parts = [base[a : a + rnd.randint(1, 200)] for a in (rnd.randint(0, 1800) for _ in range(50))]
    for length in (1, 7, 50):
        count = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, flags in zip(parts, suffix_dedup.repeated(parts, length)):
            assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(max(0, len(p) - length + 1))]


def test_chaining_finds_passages_and_leaves_the_rest(spark):
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = text(80)
    fuzzy = [w for i, w in enumerate(passage) if i not in (20, 41)]
    fuzzy[60] = "changed"
    short = text(30)
    parts = {1: (text(50), passage, text(20)), 2: (text(5), passage, text(300)), 3: (text(40), fuzzy, text(40)), 4: (text(100), short, []), 5: (text(90), short, text(9)), 6: (text(500), [], [])}
    rows = [(i, " ".join(a + b + c)) for i, (a, b, c) in parts.items()] + [(7, None), (8, ""), (9, "tiny"), (None, " ".join(text(70)))]
    out = {r.doc_id: r for r in chaining.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (2, 3):
        a, b, c = parts[i]
        assert out[i].text.split() == a + c and out[i].n_removed == len(b) and out[i].sources[0] == 1 and [(s.lo, s.hi) for s in out[i].removed] == [(len(a), len(a) + len(b))]
    for i in (1, 4, 5, 6, 8, 9):
        assert out[i].n_removed == 0 and out[i].text == dict(rows)[i]
    assert out[7].text is None and out[None].n_removed == 0


def test_working_columns_of_chaining_don_t_clash(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "one " + passage, "a", "b", "c", "d", "e", "f"), (2, passage + " two", "a", "b", "c", "d", "e", "f")] + [(3, "x", *"uvwxyz")] * 2
    df = spark.createDataFrame(rows, "c1 long, c0 string, _lo string, _hi string, _from string, _id string, _th string, sources string")
    out = chaining.dedup(df, id_col="c1", text_col="c0")
    assert out.columns == ["c1", "c0", "_lo", "_hi", "_from", "_id", "_th", "n_words", "n_removed", "removed", "sources"]
    got = sorted((r.c1, r.c0, r.n_removed, r["_lo"], r["_th"]) for r in out.collect())
    assert got == [(1, "one " + passage, 0, "a", "e"), (2, "two", 60, "a", "e"), (3, "x", 0, "u", "y"), (3, "x", 0, "u", "y")]


@pytest.mark.parametrize("hot", [2, 32])
def test_passage_that_every_document_has(spark, monkeypatch, hot):
    """hot=2: every occurrence but a slice's first goes to the slice's own bucket; nothing is lost between buckets."""
    monkeypatch.setattr(chaining, "HOT", hot)
    rnd = random.Random(19)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, short = text(70), text(20)
    rows = [(i, " ".join(text(10 + i % 7) + passage + text(120 + i % 5) + short + text(9))) for i in range(120)]
    out = {r.doc_id: r for r in chaining.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert {i: [(s.lo, s.hi) for s in r.removed] for i, r in out.items()} == {i: [(10 + i % 7, 80 + i % 7)] if i else [] for i in range(120)}


def test_passages_of_one_pair_are_judged_apart(spark):
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i, gap in enumerate((60, 100, 140)):
        head, foot, more = text(60), text(60), gap + 7 * (i % 2)
        rows += [(10 * i + 1, " ".join(head + text(gap) + foot)), (10 * i + 2, " ".join(text(9) + head + text(more) + foot + text(30)))]
        want[10 * i + 2] = [(9, 69), (69 + more, 129 + more)]
    out = {r.doc_id: r for r in chaining.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [(s.lo, s.hi) for s in r.removed] for i, r in out.items() if r.n_removed} == want


def test_passage_of_frequent_seeds_is_found(spark):
    rnd = random.Random(13)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = text(120)
    parts = [passage[a : a + 24] for a in range(0, 97, 12)]  # every 12 words or fewer of the passage, each in other documents
    rows = [(base + i, text(40) + part + text(40)) for base in (1, 61) for i, part in enumerate(parts)]
    rows += [(50, text(70) + passage + text(20)), (100, text(30) + passage + text(45) + passage)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    out = {r.doc_id: [(s.lo, s.hi) for s in r.removed] for r in chaining.dedup(df).collect() if r.n_removed}
    assert out == {100: [(30, 150), (195, 315)]}


@pytest.mark.parametrize("others", [4, 40])
def test_edited_passage_of_seeds_that_others_have_is_found(spark, others):
    """Every seed that two documents share has its first occurrence and the one before in others, few or many of them."""
    rnd = random.Random(15)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = text(63)
    edited = [w if i % 8 != 7 else f"e{i}" for i, w in enumerate(passage)]
    filler = lambda: [w for a in range(0, 63, 8) for w in text(60) + passage[a : a + 7]] + text(30)
    rows = [(i, filler()) for i in [*range(others), *range(100, 100 + others)]]
    rows += [(50, text(70) + passage + text(20)), (200, text(33) + edited + text(45))]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    out = {r.doc_id: ([(s.lo, s.hi) for s in r.removed], r.sources) for r in chaining.dedup(df).collect() if r.n_removed}
    assert out == {200: ([(33, 96)], [50])}


def test_passage_stage_of_the_pipeline_keeps_no_passage_of_seeds_that_others_have(spark):
    import corpus_pipeline

    rnd = random.Random(16)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, head, tail = text(63), text(33), text(45)
    edited = [w if i % 8 != 7 else f"e{i}" for i, w in enumerate(passage)]
    rows = [(i, [w for a in range(0, 63, 8) for w in text(60) + passage[a : a + 7]] + text(30)) for i in [*range(40), *range(100, 140)]]
    rows += [(50, text(70) + passage + text(20)), (200, head + edited + tail)]
    rows = [(i, " ".join(x), "en", "s", len(" ".join(x))) for i, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.passages(spark, df, "").collect()}
    left = " ".join(head + tail)
    assert out == {r[0]: (r[1], r[4]) for r in rows} | {200: (left, len(left))}


def test_likely_rows_are_those_with_a_passage():
    rng = np.random.default_rng(1)
    side, passages = chaining._side(50, 80), 0
    for k in range(1500):
        hit = (rng.random(400) < rng.choice([0.3, 0.6, 0.75, 0.8, 0.85])).astype(np.uint8)
        hit[200:204] = 1
        hit[: 200 - rng.integers(0, 60)] *= k % 3 > 0
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        row = hit[None, 200 - side : 200 + side]
        if any((100 * (sums[x + n] - sums[x]) >= 80 * n) for n in range(50, 100) for x in range(204 - n, 201)):
            passages += 1
            assert chaining.likely(row, 50, 80)[0] and row.sum() >= 40
    assert passages > 500 and not chaining.likely(np.arange(2 * side)[None] % 3 == 0, 50, 80)[0]


def agreeing(a, b, least=50, percent=80):
    """Which words of b lie in a range of least words or more that agrees with a's on a diagonal, by trying all ranges."""
    hit = np.zeros(len(b), bool)
    for d in range(least - len(a), len(b) - least + 1):
        lo, hi = max(0, d), min(len(b), len(a) + d)
        sums = np.concatenate([[0], np.cumsum([100 * (b[i] == a[i - d]) - percent for i in range(lo, hi)])])
        for x in range(hi - lo - least + 1):
            ok = np.flatnonzero(sums[x + least :] >= sums[x])
            if len(ok):
                hit[lo + x : lo + x + least + int(ok[-1])] = True
    return hit


def test_edited_passages_against_brute_force(spark):
    rnd = random.Random(14)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line = text(9)
    edited = lambda x, share: [w if rnd.random() >= share else f"e{rnd.randrange(10**6)}" for w in x]
    every = lambda x, k: [w if i % k != k - 1 else f"e{i}" for i, w in enumerate(x)]
    edits = [lambda x, s=s: edited(x, s) for s in (0.05, 0.1, 0.15, 0.2, 0.5) for _ in range(8)] + [lambda x, k=k: every(x, k) for k in (5, 6, 7, 8)]
    pairs = []
    for i, edit in enumerate(edits):
        one, two = text(52 + i % 9 * 6), text(100)
        pairs.append((one + line + text(60) + two + text(9), text(i) + edit(one) + text(47) + line + edit(two) + text(20)))
    rows = [(2 * i + j, " ".join(x)) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    out = {r.doc_id: r for r in chaining.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = want = 0
    for i, (a, b) in enumerate(pairs):
        brute, got = agreeing(a, b), np.zeros(len(b), bool)
        for s in out[2 * i + 1].removed:
            got[s.lo : s.hi] = True
        assert not (got & ~brute).any() and not out[2 * i].n_removed
        # Runs of agreeing ranges are passages; one is found if most of it went. What is left of one may be no passage by itself.
        for x, y in zip(np.flatnonzero(np.diff(np.append(False, brute).astype(int)) == 1), np.flatnonzero(np.diff(np.append(brute, False).astype(int)) == -1) + 1):
            want += 1
            found += got[x:y].mean() >= 0.7
    assert want > 60 and found >= 0.97 * want


def test_stretches_against_brute_force():
    rng = np.random.default_rng(5)
    rows = [rng.random(rng.integers(1, 140)) < p for p in np.linspace(0.5, 0.95, 120)]
    lo, hi = chaining.stretches(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), 50, 80)
    for r, x, y in zip(rows, lo.tolist(), hi.tolist()):
        sums = np.concatenate([[0], np.cumsum(100 * r - 80)])
        parts = [(i, j) for i in range(len(r)) for j in range(i + 50, len(r) + 1) if sums[j] >= sums[i]]
        assert (x, y) == ((min(parts)[0], max(j for _, j in parts)) if parts else (0, 0))
    assert 20 < (hi > 0).sum() < 110


def test_runs_of_a_repeated_word_make_one_row_per_two_documents():
    """The links between two runs of a word are many diagonals: they go as lists, and passages come from whole texts."""
    texts = {1: ["a"] * 30 + ["b"] * 30 + ["c"], 2: ["x"] * 7 + ["a"] * 36 + ["b"] * 33, 3: ["y", "z"] * 40}
    places = {i: [p for p in range(len(t) - 3) if t[p : p + 4] == ["a"] * 4] for i, t in texts.items()}
    ids = [i for i in texts if places[i]]
    columns = {"text": [" ".join(texts[i]) for i in ids], "id": ids, "th": ids, "h": [[5] * len(places[i]) for i in ids], "p": [places[i] for i in ids], "prev": [[-1] + [5] * (len(places[i]) - 1) for i in ids]}
    columns |= {"blocks": [[1] * len(places[i]) for i in ids], "lo": [None] * 2, "hi": [None] * 2, "ahead": [[0] * len(places[i]) for i in ids]}
    rows = pa.Table.from_batches(chaining._contexts(64)([pa.RecordBatch.from_pydict(columns)]))
    for c in ("part", "x", "y"):
        rows = rows.append_column(c, pa.array([0] * len(rows), pa.int64()))
    pairs = chaining._compared(64, 50, 80)(rows)
    assert len(pairs) == 1 and len(pairs["pb"][0]) == len(pairs["pa"][0]) > 5
    code = {w: i for i, w in enumerate(sorted({w for t in texts.values() for w in t}))}
    whole = pa.table({"id": ids, "th": ids, "w": [np.array([code[w] for w in texts[i]], np.uint32).tobytes() for i in ids], "lo": [None] * 2, "hi": [None] * 2})
    got = np.zeros(len(texts[2]), bool)
    for r in chaining._met(50, 80)(pairs, whole).to_pylist():
        assert (r["id"], r["th"], r["source"]) == (2, 2, 1)
        got[r["lo"] : r["hi"]] = True
    brute = agreeing(texts[1], texts[2])
    assert not (got & ~brute).any() and got.sum() >= 60


def hot_rows(texts, word, whole_words=False):
    """What _compared gets for the seed of four times word."""
    places = {i: [p for p in range(len(t) - 3) if t[p : p + 4] == [word] * 4] for i, t in texts.items()}
    n = len(texts)
    columns = {"text": [" ".join(t) for t in texts.values()], "id": list(texts), "th": list(texts), "h": [[5] * len(x) for x in places.values()], "p": list(places.values())}
    columns |= {"prev": [[-1] + [5] * (len(x) - 1) for x in places.values()], "blocks": [[1] * len(x) for x in places.values()], "lo": [None] * n, "hi": [None] * n, "ahead": [[0] * len(x) for x in places.values()]}
    rows = pa.Table.from_batches(chaining._contexts(64, whole_words)([pa.RecordBatch.from_pydict(columns)]))
    for c in ("part", "x", "y"):
        rows = rows.append_column(c, pa.array([0] * len(rows), pa.int64()))
    return rows


def test_runs_of_other_words_make_no_pairs():
    """Runs of the same word, too short for a passage, between runs of words of which each document has its own: no pair of
    documents is listed, whatever bits their words have in common, but those are that share enough."""
    texts = {i: [f"u{i}"] * 40 + ["the"] * 30 + [f"v{i}"] * 40 for i in range(60)}
    assert len(chaining._compared(64, 50, 80)(hot_rows(texts, "the"))) == 0
    texts = {i: [f"u{i}"] * 40 + ["the"] * (40 + i % 4) + [f"v{i}"] * 40 for i in range(60)}
    texts |= {70: ["x"] * 9 + ["the"] * 47 + list("pqrstu"), 71: ["y"] * 30 + ["the"] * 47 + list("pqrstu")}
    rows = hot_rows(texts, "the", True)
    marked = chaining._compared(64, 50, 80, mark=True)(rows)
    pairs = chaining._compared(64, 50, 80)(rows)
    assert [(x["ib"], x["ia"]) for x in pairs.to_pylist()] == [(71, 70)]
    assert len(marked) == len(set(marked["id"].to_pylist())) == 62


def test_runs_of_a_repeated_word_are_a_row_each():
    """A row per run lists the pairs of places whose words allow a passage there, all of them and no others."""
    rnd = random.Random(23)
    texts = {i: [f"u{rnd.randrange(3)}"] * rnd.randrange(50) + ["the"] * rnd.randrange(4, 70) + [f"v{rnd.randrange(3)}"] * rnd.randrange(50) for i in range(40)}
    first, n = {i: t.index("the") for i, t in texts.items()}, {i: t.count("the") - 3 for i, t in texts.items()}
    columns = {"text": [" ".join(t) for t in texts.values()], "id": list(texts), "th": list(texts), "h": [[5]] * 40, "p": [[x] for x in first.values()], "n": [[x] for x in n.values()]}
    columns |= {"prev": [[-1]] * 40, "blocks": [[1]] * 40, "ahead": [[x - 1] for x in n.values()], "lo": [None] * 40, "hi": [None] * 40}
    rows = pa.Table.from_batches(chaining._around(64, 19)([pa.RecordBatch.from_pydict(columns)]))
    assert len(rows) == 40
    for c in ("part", "x", "y"):
        rows = rows.append_column(c, pa.array([0] * len(rows), pa.int64()))
    opened, words = chaining._opened(rows, 128 + 38)
    wanted = hot_rows(texts, "the").select(["h", "id", "th", "p", "prev", "asks"])
    assert all((opened[c] == wanted[c].to_numpy(zero_copy_only=False)).all() for c in wanted.column_names)
    got = {(x["ib"], x["ia"], p, q) for x in chaining._meeting(64, 50, 80)(rows).to_pylist() for p, q in zip(x["pb"], x["pa"])}
    ids, places, prev, own = opened["id"], opened["p"], opened["prev"], words[:, 19:-19]
    want = set()
    for x in range(len(ids)):
        y = np.flatnonzero((ids < ids[x]) & ((prev[x] < 0) | (prev != prev[x])))
        if len(y):
            both = (np.broadcast_to(z, (len(y), z.shape[-1])) for z in (own[x], words[x]))
            ok = chaining.attainable(next(both), words[y], 50, 80) & chaining.attainable(own[y], next(both), 50, 80)
            want |= {(ids[x], ids[z], places[x], places[z]) for z in y[ok]}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("edit", ["leave out", "put in"])
def test_shifted_passage_of_seeds_that_others_have_is_found(spark, edit):
    """As with replaced words: each seed that two documents share is frequent, and no two parts are on one diagonal."""
    rnd = random.Random(25)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = text(63)
    edited = [w for i, w in enumerate(passage) if i % 8 != 7] if edit == "leave out" else [x for i, w in enumerate(passage) for x in ([w, f"e{i}"] if i % 8 == 6 else [w])]
    filler = lambda: [w for a in range(0, 63, 8) for w in text(60) + passage[a : a + 8][: 7 + (edit == "put in")]] + text(30)
    rows = [(i, filler()) for i in [*range(40), *range(100, 140)]]
    rows += [(50, text(70) + passage + text(20)), (200, text(33) + edited + text(45))]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    out = {r.doc_id: ([(s.lo, s.hi) for s in r.removed], r.sources) for r in chaining.dedup(df).collect() if r.n_removed}
    assert list(out) == [200] and out[200][1] == [50]
    (lo, hi), = out[200][0]
    assert 33 <= lo <= 35 and 33 + len(edited) - 2 <= hi <= 33 + len(edited)


def test_first_comparison_turns_no_attainable_pair_away():
    rnd, allowed = np.random.default_rng(26), 0
    base = rnd.integers(1, 400, 300).astype(np.uint16) * 97 | 1
    def around(n):  # noqa: E306
        rows = []
        for _ in range(n):
            at, share = int(rnd.integers(90, 200)), rnd.choice([0.0, 0.05, 0.12, 0.2, 0.4])
            kind = rnd.random(166)
            source = np.clip(at - 83 + np.arange(166) + np.cumsum(rnd.integers(-1, 2, 166) * (kind < share / 2)) * (np.arange(166) > 83), 0, 299)
            rows.append(np.where((kind >= share) | (abs(np.arange(166) - 84) < 3), base[source], rnd.integers(1, 1 << 15, 166) * 2 + 1).astype(np.uint16))
        return np.stack(rows)
    b, a = around(60), around(60)
    b[:8, :70], a[4:12, -60:] = 0, 0
    fast = chaining.shifted(b[:, 19:-19], chaining._has(a, 19), 50, 80)
    for x in range(60):
        slow = chaining.attainable(np.broadcast_to(b[x, 19:-19], (60, 128)), a, 50, 80)
        assert not (slow & ~fast[x]).any()
        allowed += slow.sum()
    assert allowed > 100 and fast.mean() < 0.9


def test_runs_of_a_repeated_word_are_not_listed_by_place(spark, monkeypatch):
    rnd, counts, write = random.Random(24), {}, chaining.materialize

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.selectExpr("sum(size(p))").collect()[0][0] or 0 if name == "marked" else out.count()
        return out

    monkeypatch.setattr(chaining, "materialize", counted)
    texts = {i: [f"u{i}"] * 30 + ["the"] * rnd.randrange(20, 45) + [f"v{i}"] * 30 for i in range(60)}
    texts |= {90 + i: [f"x{i}"] * 30 + ["the"] * 46 + list("pqrst") for i in range(2)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in chaining.dedup(df).collect()}
    assert counts.get("marked", 0) < 62 and max(counts[c] for c in ("hot", "around", "contexts") if c in counts) < 62 * 10
    assert [(s.lo, s.hi) for s in out[91].removed] == [(30, 81)] and out[90].n_removed == 0


def test_what_is_attainable_includes_every_passage():
    """Passages with words replaced, left out and put in, around a seed: none is turned away."""
    rnd, passages, away = random.Random(21), 0, 0
    for k in range(600):
        a = [rnd.randrange(1, 1 << 31) for _ in range(rnd.randrange(60, 260))]
        middle = rnd.randrange(len(a) - 4)
        lo, hi = max(0, middle - rnd.randrange(10, 90)), min(len(a), middle + 4 + rnd.randrange(10, 90))
        b, at = [rnd.randrange(1 << 31, 1 << 32) for _ in range(rnd.randrange(90))], 0
        share = rnd.choice([0.02, 0.08, 0.15, 0.3])
        for x in range(lo, hi):
            if x == middle:
                at = len(b)
            kind = rnd.random() / share if not middle <= x < middle + 4 else 9
            b += [rnd.randrange(1 << 31, 1 << 32)] * (kind < 0.7) + [a[x]] * (kind >= 0.7 or kind < 0.35)
        b += [rnd.randrange(1 << 31, 1 << 32) for _ in range(rnd.randrange(90))]
        mb, ma = (np.array(z) for z in chaining._matched(b, a))
        has = any(x <= at < y for x, y in chaining.judged(mb, ma, 50, 80)) if len(mb) else False
        around = lambda z, p: np.array([([0] * 64 + z + [0] * 64)[p : p + 128]], np.uint32)
        ok = bool(chaining.attainable(around(b, at), around(a, middle), 50, 80)[0])
        passages += has
        away += not ok
        assert ok or not has
    assert passages > 150 and away > 50


def test_what_is_not_promising_has_no_passage():
    rnd = np.random.default_rng(8)
    rows = [(rnd.random(rnd.integers(0, 260)) < p) for p in np.linspace(0.3, 0.95, 400)] + [np.arange(99) % 5 != 2, np.arange(50) % 5 != 2, (np.arange(50) % 5 != 2) & (np.arange(50) != 10)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    go = chaining.promising(np.concatenate(rows), at, 50, 80)
    has = np.array([bool(chaining.judged(np.flatnonzero(r), np.flatnonzero(r), 50, 80)) for r in rows])
    assert not (has & ~go).any() and 50 < has.sum() < go.sum() < 350 and has[-3] and has[-2] and not has[-1]


def test_runs_meet_wherever_passages_do():
    """Any 50 words in a row have a run that the same words have in another text, in slices of several texts too."""
    rnd = np.random.default_rng(3)
    for _ in range(40):
        passage = rnd.integers(0, 1 << 60, 50).astype(np.uint64)
        texts = [np.concatenate([rnd.integers(0, 1 << 60, n).astype(np.uint64), passage, rnd.integers(0, 1 << 60, m).astype(np.uint64)]) for n, m in ((0, 0), (7, 90), (200, 3))] + [passage[:49]]
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        h, text, place = chaining.runs(np.concatenate(texts), at, 50)
        found = [{(int(x), int(p) - n) for x, t, p in zip(h, text, place) if t == i and n <= p <= n + 19} for i, n in enumerate((0, 7, 200))]
        assert found[0] & found[1] & found[2] and not (text == 3).any()
        assert len(h) < 0.25 * at[-1]


def test_seeds_of_a_very_long_text():
    n = (1 << 22) + 100
    h, text, place = chaining.seeds(mix64(np.arange(n, dtype=np.uint64)), np.array([0, n]))
    assert int(place.max()) >= 1 << 22 and not text.any()


def test_chain_scores_match_quadratic_search():
    rnd = random.Random(1)
    for _ in range(60):
        matches = sorted({(rnd.randrange(120), rnd.randrange(120)) for _ in range(rnd.randrange(1, 40))})
        score = []
        for b, a in matches:
            best = max((s - chaining.COST * ((b - y) + (a - x)) / 2 for s, (y, x) in zip(score, matches) if y < b and x < a), default=0)
            score.append(chaining.EARN + max(0, best))
        found = chaining.chains([b for b, _ in matches], [a for _, a in matches])
        assert sorted(i for c in found for i in c) == list(range(len(matches)))
        chain = found[0]
        total = chaining.EARN * len(chain) - sum(chaining.COST * (matches[j][0] - matches[i][0] + matches[j][1] - matches[i][1]) / 2 for i, j in zip(chain, chain[1:]))
        assert total == pytest.approx(max(score))
        assert all(matches[i][0] < matches[j][0] and matches[i][1] < matches[j][1] for i, j in zip(chain, chain[1:]))


def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert chaining.common(a, b) == t[-1][-1]


def test_media_round_trip(docs, monkeypatch):
    monkeypatch.setattr(media, "LEAST", 128)
    monkeypatch.setattr(media, "MOST", 512)
    manifest = media.manifests(docs)
    stored = media.store(docs, manifest)
    back = {bytes(r.payload): r for r in media.read_back(stored, with_payload=True).collect()}
    payloads = collections.Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        payloads[r.doc_id, len(raw), raw + b"\xff" * (-len(raw) % 576 if raw else 576)] += 1
    assert collections.Counter({(i, n, hashlib.sha256(p).digest()): m for (i, n, p), m in payloads.items()}) == collections.Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in manifest.collect())
    assert len(back) == len({p for *_, p in payloads})
    pack = zstandard.ZstdCompressor(level=media.LEVEL)
    for *_, payload in payloads:
        x, ends = back[hashlib.sha256(payload).digest()], media.cuts(payload)
        form = b"".join(pack.compress(payload[a:b]) for a, b in zip([0, *ends], ends))
        share = [payload.count(bytes([v])) / len(payload) for v in set(payload)]
        mean = sum(payload) / len(payload)
        dev = (sum((v - mean) ** 2 for v in payload) / len(payload)) ** 0.5
        step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (len(payload) - 1)
        assert (bytes(x.data), x.payload_bytes, x.payload_sha256, x.tail_crc32) == (payload, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        values = dict(v.split("=") for v in x.feature.split(";"))
        assert [float(values[k]) for k in ("mean", "dev", "entropy", "step", "samples")] == pytest.approx([mean, dev, -sum(v * math.log2(v) for v in share), step, len(payload)], abs=1e-4)
    packs = [p for part in stored.packs for p in part.collect()]
    digests = [bytes(c.digest) for p in packs for c in p.own]
    assert len(digests) == len(set(digests)) and any(p.foreign for p in packs)


def test_chunk_cuts_follow_content():
    rnd = random.Random(8)
    a = bytes(rnd.randrange(256) for _ in range(60_000))
    ends = set(media.cuts(a))
    moved = {c - 7 for c in media.cuts(b"prefix!" + a)}
    assert len(ends & moved) > len(ends) * 0.6 and max(ends) == len(a)
    assert all(y - x <= media.MOST for x, y in zip([0, *sorted(ends)], sorted(ends)))


def test_small_payloads_share_chunks():
    rnd = random.Random(15)
    text = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
    stored = shared = 0
    for _ in range(40):
        passage = text(2500)
        one, two = (media.padded(x) for x in (text(400) + passage, text(700) + passage + text(200)))
        first, second = ({p[a:b] for a, b in zip([0, *media.cuts(p)], media.cuts(p))} for p in (one, two))
        stored += len(passage)
        shared += sum(map(len, first & second))
    assert shared > 0.3 * stored


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    goal, total, level = {}, sum(size.values()), dict(zip(sorted(size, key=lambda s: (s is None, s)), [1, 2, 3, 1, 2, 3]))
    open_ = {s for s in size if size[s]}
    rest = total
    while open_:
        share = {s: rest * level[s] / sum(level[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 3.0 * size[s] for s in over}
        rest -= sum(3 * size[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal.get(r.source, 0)) and len(r.placements) <= 3
        assert len({p.copy for p in r.placements}) == len(r.placements)
        taken[r.source] += len(r.placements) * r["size"]
    assert all(abs(taken[s] - goal.get(s, 0)) <= largest for s in size)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_shards_hold_what_was_drawn(spark):
    docs = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    made = mixing.plan(docs, shards=4, block_words=100)
    out = mixing.shuffled(docs, made).collect()
    mixed = mixing.mix(docs, shards=4, block_words=100).collect()
    assert collections.Counter(r.doc_id for r in out) == {r.doc_id: len(r.placements) for r in mixed if r.placements}
    assert sorted((r.doc_id, r.copy, r.shard) for r in out) == sorted((r.doc_id, p.copy, p.shard) for r in mixed for p in r.placements)
    shard = collections.Counter(r.shard for r in out)
    assert set(shard) <= set(range(4)) and len(shard) == 4


@pytest.mark.parametrize("most", [4096, 3])
def test_mix_of_null_ids_and_large_blocks(spark, monkeypatch, most):
    """most=3: blocks far beyond their size, of which one is cut again."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", most)
    monkeypatch.setattr(mixing, "SMALL", 2 if most == 3 else 1 << 17)
    rnd = random.Random(16)
    rows = [(None if i % 3 else i, "w " * rnd.randrange(1, 40) + str(i), "ab"[i % 4 == 0]) for i in range(2000)] + [(7, "x y z", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_words=500).collect()
    taken, goal = collections.Counter(), {}
    for r in got:
        taken[r.source] += r["size"] * len(r.placements)
        goal[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 40 for s in goal)
    assert len({len(r.placements) for r in got if r.doc_id == 7}) == 1


def test_hypergeometric_draws(spark):
    """The inverse distribution at evenly spread points has the exact mean and stays within its bounds."""
    df = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    for n, k, m in ((50, 20, 10), (4000, 1500, 2000), (10, 10, 3), (7, 0, 3)):
        x = df.select(F.expr(mixing._draw(f"{n}L", f"{k}L", f"{m}L", "u")).alias("x")).agg(F.avg("x").alias("a"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()[0]
        assert x.a == pytest.approx(m * k / n, rel=0.01, abs=0.02) and x.lo >= max(0, m - (n - k)) and x.hi <= min(k, m)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module, label, held, best", [(toxicity, "toxic", (4, 2), 0.75), (quality, "quality", (5, 0), 0.95)])
def test_classifiers_on_rows_left_out(spark, module, label, held, best):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    out = module.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    left = out[[zlib.crc32(str(i).encode()) % held[0] == held[1] for i in out.doc_id]]
    score = left[f"{label}_score"].to_numpy()
    assert ((score >= 0) & (score <= 1)).all() and auc(score, left[label].to_numpy()) > best


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(spark, docs, empty, module, label):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], "doc_id long, toxic int, quality int")
    for labels, source in ((none, docs), (one, docs), (none, empty)):
        out = module.score(docs, module.train(source, labels)).select(f"{label}_score").collect()
        assert len({r[0] for r in out}) == 1 and len(out) == docs.count() and 0 <= out[0][0] <= 1
    assert module.score(empty, module.train(docs, none)).count() == 0


def test_empty_tables(empty):
    assert jaccard.join(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0 and chaining.dedup(empty).count() == 0
    assert sentencepiece_bpe.digests(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert media.read_back(media.store(empty, media.manifests(empty))).count() == 0


def test_awkward_rows_keep_their_columns(docs):
    out = chaining.dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert sentencepiece_bpe.encode(docs).count() == docs.count()


def test_scores_don_t_depend_on_the_batch(spark, docs, sf_dir):
    """Each text alone has the score that it has among others; repeated rows have equal scores, long texts are scored whole."""
    base, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, long), (901, long + " kill"), (902, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, column in ((toxicity, "toxic_score"), (quality, "quality_score")):
        model = module.train(base, labels)
        scored = collections.defaultdict(set)
        for r in module.score(df, model).collect():
            scored[r.text].add(r[column])
        for text, found in scored.items():
            alone = model.scores(*binary_parts(pa.array([text], pa.string())))[0]
            assert max(found) - min(found) < 1e-6 and found.pop() == pytest.approx(alone, abs=1e-5) and 0 <= alone <= 1


def repeating(rnd, n):
    """Words with runs of one repeated word and lines that come again."""
    line, out = [f"l{rnd.randrange(3)}{k}" for k in range(12)], []
    while len(out) < n:
        out += rnd.choice([["the"] * rnd.randrange(5, 50), line[: rnd.randrange(4, 13)], [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 20))]])
    return out[:n]


def test_dense_chains_are_those_of_the_tree(monkeypatch):
    rnd = random.Random(31)
    for _ in range(40):
        matches = sorted({(rnd.randrange(25), rnd.randrange(40)) for _ in range(rnd.randrange(20, 500))})
        pb, pa_ = [x for x, _ in matches], [y for _, y in matches]
        monkeypatch.setattr(chaining, "DENSE", 1 << 30)
        slow = chaining.chains(pb, pa_)
        monkeypatch.setattr(chaining, "DENSE", 0)
        assert chaining.chains(pb, pa_) == slow


def test_chains_that_are_not_aligned_have_no_passage(monkeypatch):
    """The bound leaves out nearly all chains between runs of a repeated word, and none with words that an alignment finds."""
    rnd, tried, gone = random.Random(32), 0, 0
    for k in range(60):
        a, b = repeating(rnd, rnd.randrange(60, 300)), repeating(rnd, rnd.randrange(60, 300))
        if k % 2:
            a[20:20] = [w for w in b[10:70] if rnd.random() > 0.1]
        code = {w: i for i, w in enumerate(sorted({*a, *b}))}
        b, a = (np.array([code[w] for w in z], np.uint32) for z in (b, a))
        (hb, _, pb), (ha, _, pa_) = (chaining.seeds(mix64(z.astype(np.uint64)), np.array([0, len(z)])) for z in (b, a))
        x, y = np.nonzero(hb[:, None] == ha[None])
        xs, ys, _ = chaining.thinned(pb[x], pa_[y], np.ones(len(x), np.int64)) if len(x) else (pb[x], pa_[y], x)
        paths = chaining.chains(xs.tolist(), ys.tolist()) if len(xs) else []
        left = np.arange(len(b)) % 90 < 45
        may = {tuple(c): m for c, m in chaining._worth(b, a, xs, ys, paths, left, 50, 80)}
        tried, gone = tried + len(paths), gone + len(paths) - len(may)
        for c in paths:
            for lo, hi in chaining.judged(*chaining.agreed(b, a, xs[c], ys[c]), 50, 80):
                assert not left[lo:hi].any() or (tuple(c) in may and may[tuple(c)][lo:hi][left[lo:hi]].all())
    assert gone > 0.5 * tried > 500


def test_words_within_passages_against_brute_force():
    rng = np.random.default_rng(33)
    rows = [rng.random(rng.integers(1, 140)) < p for p in np.linspace(0.5, 0.95, 120)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    may = chaining.within(np.concatenate(rows), at, 50, 80)
    for k, r in enumerate(rows):
        sums, own = np.concatenate([[0], np.cumsum(100 * r - 80)]), np.zeros(len(r), bool)
        for i in range(len(r)):
            for j in range(i + 50, len(r) + 1):
                own[i:j] |= r[i] and r[j - 1] and sums[j] >= sums[i]
        assert (own == may[at[k] : at[k + 1]]).all()
