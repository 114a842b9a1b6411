"""Phrase dedup, spelling variants and whitening against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import brute
import tiltframe.llm.phrase_dedup as pd_
import tiltframe.llm.spelling as sp
import tiltframe.llm.whitening as wh
from tiltframe.llm.queries import op12_spelling_variants, op13_whitening
from conftest import SF_SMALL
from tiltframe.llm.storage import Scratch

DOCS = "doc_id long, text string"


# -- phrases -----------------------------------------------------------------


def phrases(docs, length):
    low = lambda d: -(1 << 63) if d is None else d
    split = [(d, brute.WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            p = tuple(w[i : i + length])
            first[p] = min(first.get(p, (low(d), i)), (low(d), i))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (low(d), i):
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def _phrase_docs():
    r = random.Random(7)
    v = [f"w{i}" for i in range(400)] + ["É", "é", "日本", "the", "the", "The"]
    passage = [r.choice(v) for _ in range(60)]
    docs = [(None, None), (0, None), (1, ""), (2, " \t\n\x0b "), (3, "a " * 90), (4, "a b " * 40), (5, "x"), (None, " ".join(passage[:30]))]
    for i in range(60):
        a, b = r.randrange(30), r.randrange(31, 60)
        text = [r.choice(v) for _ in range(r.randrange(40))] + passage[a:b] + [r.choice(v) for _ in range(r.randrange(40))]
        docs.append((10 + i % 50, "  ".join(text) if i % 3 else "\n".join(text)))  # ids come again
    docs += [(200 + i, " ".join(passage)) for i in range(30)] + [(201, " ".join(passage))] * 3
    docs += [(300 + i, " ".join([r.choice(v) for _ in range(25)] + passage[10:18] + [r.choice(v) for _ in range(25)])) for i in range(40)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("kinds", [500, 3])
def test_phrases(spark, monkeypatch, kinds):
    monkeypatch.setattr(pd_, "MAX_KINDS", kinds)  # 3: by window
    monkeypatch.setattr(pd_, "SHARD_WINDOWS", 300)
    docs = _phrase_docs()
    df = spark.createDataFrame([(d, t, 5, "k") for d, t in docs], DOCS + ", kept int, anchor string").repartition(3)
    out = pd_.phrase_dedup(spark, df)
    assert sorted(out.columns) == ["anchor", "doc_id", "kept", "n_removed", "n_words", "text"]
    assert _got(out) == phrases(docs, 20)


def test_phrases_of_other_length(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(40)]
    assert _got(pd_.phrase_dedup(spark, spark.createDataFrame(docs, DOCS), length=8)) == phrases(docs, 8)


def test_phrases_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pd_, "PIECE_BYTES", 700)  # pieces, and words longer than one
    r = random.Random(2)
    v = [f"word{i}" for i in range(300)] + ["z" * 900]
    base = [r.choice(v) for _ in range(3000)]
    docs = [(1, " ".join(base)), (2, " ".join(base[700:1900] + ["end"] + base[:40])), (3, "y" * 5000), (4, " ".join(["q" * 1000] * 30))]
    assert _got(pd_.phrase_dedup(spark, spark.createDataFrame(docs, DOCS))) == phrases(docs, 20)


def test_phrases_of_no_documents(spark):
    assert pd_.phrase_dedup(spark, spark.createDataFrame([], DOCS)).count() == 0


# -- spelling -----------------------------------------------------------------


def counted(docs, drop=97):
    import re

    out = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(vocabulary, ratio=2):
    """All pairs by way of words with one place open."""
    near = {w: set() for w in vocabulary}
    spots = {}
    for w in vocabulary:
        for i in range(len(w)):
            spots.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if (cut := w[:i] + w[i + 1 :]) in near:
                near[w].add(cut), near[cut].add(w)
    for many in spots.values():
        for a, b in itertools.combinations(many, 2):
            if a != b:
                near[a].add(b), near[b].add(a)
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else vocabulary[form[w]]))
    return sorted(out)


def _words_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = _words_of(op12_spelling_variants(spark, SF_SMALL))
    assert got == grouped(counted(rows)) and len(got) > 100


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(sp, "_PIECE", 50)
    monkeypatch.setattr(sp, "_FLUSH", 20)
    r = random.Random(5)
    v = ["Hello", "HELLO", "ÀÉÎõü", "abcd", "a×b÷cd", "naïveté", "x" * 300] + [f"{chr(97 + i)}yield" for i in range(20)]
    docs = [(None if i % 7 == 0 else i % 5, "".join(r.choice(v) + r.choice([" ", "1", "-", "_", "日", "Ÿ"]) for _ in range(r.randrange(60)))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "12 34"), (4, "hello" * 5000), (4, "hello" * 5000), (9, "hello" * 5000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS + ", word int")
    for drop in (97, 3, None):
        got = {r.word: r.n for r in sp.word_counts(df, drop_every=drop).collect()}
        assert got == counted(docs, drop)


@pytest.mark.parametrize("max_bytes", [sp.MAX_FILTER_BYTES, 1024])
def test_variants(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(sp, "_PROBES", 500)
    r = random.Random(11)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(1500)} | {"q" * 400, "q" * 401, "日本語", "日本誌", "\U0001f600a"}
    vocabulary = {w: r.choice([1, 2, 2, 3, 5, 8, 100]) for w in sorted(words)}
    rows = [(w, n, 7) for w, n in vocabulary.items()] + [(None, 3, 1), ("gone", None, 1)]
    df = spark.createDataFrame(rows, "word string, n long, form int")
    if max_bytes == 1024:
        assert len(sp.rounds({5: 20000}, 1024)) > 1
    assert _words_of(sp.variants(spark, df, max_bytes=max_bytes)) == grouped(vocabulary)


def test_variants_of_no_words(spark):
    assert sp.variants(spark, spark.createDataFrame([], "word string, n long")).count() == 0
    twice = spark.createDataFrame([("seven", 2), ("seven", 3), ("eleven", 1)], "word string, n long")
    assert _words_of(sp.variants(spark, twice)) == [("eleven", None, "eleven", 1, 0, None), ("seven", None, "seven", 5, 0, None)]


def test_filters_hold_their_words(spark):
    """No word is missed and about one in a hundred others passes."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(10)) for _ in range(4000)]
    inside, outside = sorted(set(words[:2000])), sorted(set(words[2000:]) - set(words[:2000]))
    df = spark.createDataFrame([(w,) for w in inside], "word string")
    rnd = sp.rounds({10: len(inside)})[0]
    table = sp._filter(df, rnd)

    def passing(ws):
        h = sp._Words(ws).whole()
        m = sp._mask(h)
        return int(((table[rnd.place(h, 10)] & m) == m).sum())

    assert passing(inside) == len(inside) and passing(outside) < len(outside) * 0.03


def test_hashes_of_edits():
    """The rolling hash of an edit is the hash of the edited word."""
    r = random.Random(4)
    words = ["".join(r.choice("abcé日") for _ in range(r.randrange(1, 12))) for _ in range(200)]
    w = sp._Words(words)
    j = np.arange(len(w.points))
    name, place = [words[i] for i in w.word], w.place.tolist()
    cut = [x[:p] + x[p + 1 :] for x, p in zip(name, place)]
    long = [i for i, c in enumerate(cut) if c]
    assert (w.deletions(j)[long] == sp._Words([cut[i] for i in long]).whole()).all()
    put = sp._Words([x[:p] + "z" + x[p + 1 :] for x, p in zip(name, place)]).whole()
    assert (w.replacements(j, sp._value(np.full(len(j), ord("z"), dtype=np.uint32))) == put).all()


# -- whitening -----------------------------------------------------------------


@pytest.mark.parametrize("spectrum", ["spread", "tight", "equal", "rank", "one", "negative"])
def test_components(spectrum):
    r = np.random.default_rng(1)
    d = 40
    e = {
        "spread": np.geomspace(1e-12, 1e3, d), "tight": 1.0 + np.arange(d) * 1e-7, "equal": np.full(d, 2.0),
        "rank": np.r_[np.zeros(d - 3), 1.0, 1.0, 5.0], "one": np.r_[np.full(d - 1, 1.0), 9.0], "negative": np.linspace(-1, 1, d),
    }[spectrum]
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = wh.top_components(a, 4)
    scale = np.abs(e).max()
    assert np.allclose(values, np.sort(e)[::-1][:4], rtol=0, atol=1e-12 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale


def test_polar():
    r = np.random.default_rng(2)
    q, _ = np.linalg.qr(r.standard_normal((30, 30)))
    e = r.standard_normal(30) * np.geomspace(1e-9, 1, 30)
    u = wh.polar((q * e) @ q.T)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-12
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-5  # eigenvalues near 0 are near either sign


def whitened(rows, k=4, scale=256):
    """{vec_id, row number: (n, deviation, whitened, explained)} by eigh."""
    keep = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in keep} - {0}:
        mine = [(i, x) for i, x in keep if len(x) == d]
        fit = sorted({tuple(x) for _, x in mine})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        mean = [Fraction(t, n) for t in s]
        c = np.array([[float(v - m) for v, m in zip(x, mean)] for x in fit])
        cov = c.T @ c / n
        e, vec = np.linalg.eigh(cov)
        e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
        for i, x in mine:
            dev = sum((n * v - t) ** 2 for v, t in zip(x, s))
            w = [float(np.array([float(v - m) for v, m in zip(x, mean)]) @ vec[:, j]) / math.sqrt(e[j]) if e[j] > 1e-9 * cov.trace() else None for j in range(len(e))]
            out.append((i, n, dev if dev < 1 << 63 else None, w, [float(v / cov.trace()) if cov.trace() > 0 else None for v in e]))
    return out


def _same(got, want):
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.deviation, r.n), {}).setdefault(r.component, []).append(r)
    assert len(got) == sum(len(w[4]) for w in want)
    for i, n, dev, w, share in want:
        rows = mine[i, dev, n]
        assert sorted(rows) == list(range(1, len(share) + 1))
        for j, (a, b) in enumerate(zip(w, share)):
            values = [r.whitened for r in rows[j + 1]]
            assert all(r.explained is None if b is None else abs(r.explained - b) <= 1e-9 for r in rows[j + 1])
            assert None in values if a is None else any(v is not None and abs(abs(v) - abs(a)) < 1e-6 * max(1, abs(a)) for v in values)


def test_whitening_of_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = op13_whitening(spark, SF_SMALL).collect()
    _same(got, whitened(rows))
    assert {r.identity_error for r in got} != {None} and max(r.identity_error for r in got) < 1e-9
    # one sign a component for all rows
    by = {(r.vec_id, r.component): r.whitened for r in got}
    want = whitened(rows)
    for j in range(4):
        assert len({np.sign(by[i, j + 1]) * np.sign(w[j]) for i, _, _, w, _ in want if abs(w[j]) > 1e-3}) == 1


def test_whitening_cases(spark):
    r = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, (r.standard_normal(6) * [5, 4, 3, 2, 1, 0.5] + 1000).tolist()) for i in range(80)]
    rows += [(7, rows[3][1])] * 30 + [(None, rows[4][1]), (90, None), (91, []), (92, [nan] * 6), (93, [inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (94, [None] * 6), (95, [-0.0] * 6)]
    rows += [(200 + i, r.standard_normal(2).tolist()) for i in range(9)] + [(300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, n int, whitened string").repartition(4)
    got = wh.whiten(spark, df).collect()
    assert wh.whiten(spark, df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _same(got, whitened(rows))
    assert {r.whitened for r in got if r.vec_id == 300} == {None}
    assert wh.whiten(spark, df.limit(0)).count() == 0


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(1 << 44) + i, 3.0 * i * i, -1e9 * i]) for i in range(40)] + [(99, [1e300, 0.0, 1.0])]
    got = wh.whiten(spark, spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>")).collect()
    _same(got, whitened(rows[:-1]))
    assert wh.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 41 * 3


def test_fit_is_a_model(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(35)] * 2
    x = wh.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    model = wh.fit(spark, x, 2, Scratch(spark, "fit"))[2]
    assert model.n == 35 and model.identity_error < 1e-12
    assert np.allclose(model.project(np.array([[256, 512]])), model.project(np.array([[256, 512]])))
