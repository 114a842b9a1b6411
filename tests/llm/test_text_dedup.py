"""Line dedup, substring dedup and the Jaccard join against brute force."""

import random

import numpy as np
import pytest

import brute
import tiltframe.llm.jaccard_join as jj
import tiltframe.llm.suffix_dedup as sd
from conftest import SF_SMALL
from tiltframe.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


def _real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


def _words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


# -- lines


def _line_docs():
    hot, upper = "a line of forty characters and some more", "A LINE OF FORTY CHARACTERS AND SOME MORE"
    docs = [(i, f"own {i}\n{hot if i % 2 else '  ' + upper + chr(9)}\nshort") for i in range(6)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (23, hot + "\n" + hot), (23, hot), (None, hot), (24, "é" * 39), (25, "x" * 30000)]
    docs += [(30 + i, "é" * 40) for i in range(5)]
    return docs


def test_lines(spark):
    docs = _line_docs()
    df = spark.createDataFrame([(*d, i, "k") for i, d in enumerate(docs)], SCHEMA + ", n_lines int, pos string")
    out = line_dedup(df)
    assert sorted(out.columns) == ["doc_id", "n_dropped", "n_lines", "pos", "text"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == brute.line_dedup(docs)


def test_repeated_rows_are_one_document(spark):
    """Lines count by doc_id, in the operator, by brute force and in SQL."""
    import duckdb

    from tiltframe.llm.queries import OP2_SQL

    line = "one line of more than forty characters, held by many rows"
    docs = [(1, line), (1, line + "\nown"), (1, line), (1, "x\n" + line), (2, line), (None, None), (None, None)]
    more = docs + [(3, line), (4, line), (None, line)]
    for rows, dropped in ((docs, 0), (more, 7)):
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(df).collect()), key=str)
        assert got == brute.line_dedup(rows) and sum(g[2] for g in got) == dropped
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        sql = sorted(((*r[:3], r[3]) for r in con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP2_SQL})").fetchall()), key=str)
        assert sql == sorted(((d, n, k, brute.sha(t.encode())) for d, n, k, t in got), key=str)


def test_lines_of_no_documents(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


# -- substrings


def _repeat_docs():
    r = random.Random(3)
    v = [f"w{i}" for i in range(3000)] + ["é", "日本"]
    passage, base = _words(r, 70, v), _words(r, 300, v)
    docs = [(0, None), (1, ""), (2, "a" * 1000), (3, "ab" * 300), (4, "x" * 199), (5, "x" * 200), (6, "x" * 201)]
    docs += [(10 + i, f"{_words(r, 60, v)} {passage[r.randrange(30):]} {_words(r, 30, v)}") for i in range(40)]
    for i in range(20):
        w = base.split()
        w[r.randrange(300)] = r.choice(v)
        docs.append((100 + i, " ".join(w)))
    return docs + [(200, base), (200, base), (201, _words(r, 100, v)), (201, _words(r, 50, v) + passage), (None, base[50:800]), (300, _words(r, 4000, v))]


def _substrings(spark, docs):
    out = sd.suffix_dedup(spark, spark.createDataFrame(docs, SCHEMA)).collect()
    for r in out:
        assert r.kept_text.encode() in (bytes(r.kept), r.kept_text.encode())
        assert len(r.kept_text.encode()) <= len(r.kept)
    return sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out), key=str)


@pytest.mark.parametrize("name,value", [(None, None), ("MAX_GROUP", 10), ("PIECE_BYTES", 3000), ("BLOCK_BYTES", 2000)])
def test_substrings(spark, monkeypatch, name, value):
    if name:
        monkeypatch.setattr(sd, name, value)
    docs = _repeat_docs()
    assert _substrings(spark, docs) == brute.substring_dedup(docs)


def test_substrings_of_documents(spark):
    docs = _real(spark)
    assert _substrings(spark, docs) == brute.substring_dedup(docs)


def test_substrings_of_no_documents(spark):
    assert sd.suffix_dedup(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_interval_expansion():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab\x00") for _ in range(r.randrange(1, 60))) for _ in range(40)]
    for length in (1, 3, 6, 12):
        seen = {}
        for s in strings:
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
        got = sd.repeated_windows(strings, np.ones(len(strings), dtype=np.int64), length)
        for g, s in zip(got, strings):
            assert g.tolist() == [i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]
    lone = sd.repeated_windows([b"abcdef"], np.array([2]), 3)
    assert lone[0].tolist() == [0, 1, 2, 3]


def test_blocks_are_cut_down_before_the_transform(monkeypatch):
    r = random.Random(5)
    given, plain = [], sd.repeated_windows

    def watched(strings, times, length):
        given.extend(strings)
        return plain(strings, times, length)

    monkeypatch.setattr(sd, "repeated_windows", watched)
    length = 12
    shared = bytes(r.choice(b"cd") for _ in range(40))  # equal windows have equal anchors
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(12, 60))) for _ in range(60)]
    strings += [bytes([i]) * 9 + shared + bytes([i + 100]) * 3 for i in range(3, 90)] + [bytes(range(196, 256))]
    keys = [(0 if i < 60 else 7, i) for i in range(len(strings))]
    times = np.array([1 + (i % 11 == 0) for i in range(len(strings) - 1)] + [1])
    seen = {}
    for s, t in zip(strings, times.tolist()):
        for i in range(len(s) - length + 1):
            seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + t
    got = {(o, j) for _, o, a, b in sd._block_ranges(keys, strings, times, length) for j in range(a, b)}
    assert got == {(o, i) for (_, o), s in zip(keys, strings) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}
    assert 0 < len(given) < len(strings) and strings[-1] not in given
    # what is left of a passage in different surroundings is one string
    given.clear()
    got = sd._block_ranges([(1, i) for i in range(80)], [bytes([i + 100]) * 9 + shared + bytes([i + 1]) * 3 for i in range(80)], np.ones(80, dtype=np.int64), 40)
    assert sorted(got) == [(1, i, 9, 10) for i in range(80)] and not given


# -- near duplicates


def _near_docs():
    r = random.Random(1)
    v = [f"w{i}" for i in range(4000)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, " \n")]
    for _ in range(30):
        w = [r.choice(v) for _ in range(r.choice([3, 8, 12, 20, 40, 80, 150, 400]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            x = list(w)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(w) // 60 + 1])):
                x[r.randrange(len(x))] = r.choice(v)
            docs.append((len(docs) + 5, " ".join(x[:-1] or x if r.random() < 0.2 else x)))
    passage = _words(r, 60, v)
    docs += [(1000 + i, _words(r, r.randrange(20, 60), v) + " " + passage) for i in range(60)]
    return docs


@pytest.mark.parametrize("k,num,den,chunk", [(3, 9, 10, None), (5, 4, 5, None), (3, 9, 10, 500), (3, 1, 2, None)])
def test_near_duplicates(spark, monkeypatch, k, num, den, chunk):
    if chunk:
        monkeypatch.setattr(jj, "CHUNK_TOKENS", chunk)
    docs = _near_docs()
    got = sorted(tuple(r) for r in jj.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), k, num, den).collect())
    assert got == brute.near_duplicates(docs, k, num, den)


def test_near_duplicates_of_documents(spark):
    docs = _real(spark)
    got = sorted(tuple(r) for r in jj.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == brute.near_duplicates(docs, 3, 9, 10)


def test_near_duplicates_odd_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten"
    docs = [(5, a), (5, b), (7, a), (9, b), (None, a)]
    out = jj.near_duplicates(spark, spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", sig int, rep string"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 2, 5), (7, 4, 5), (9, 2, 5), (None, 4, None)], key=str)
    assert jj.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_of_a_linked_pair_meet():
    """Pigeonhole: any two sets over the threshold share a signature."""
    r = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        bands = jj.Bands(num, den)
        for _ in range(300):
            n = int(r.integers(2, 400))
            x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            y = x.copy()
            while True:  # change one token after the other as long as the pair stays linked
                z = np.unique(np.append(np.delete(y, r.integers(len(y))), r.integers(0, 2**63, 1, dtype=np.uint64))) if r.random() < 0.7 else np.delete(y, r.integers(len(y)))
                common = len(np.intersect1d(x, z))
                if not len(z) or den * common < num * (len(x) + len(z) - common):
                    break
                y = z
            assert len(np.intersect1d(jj.signatures(x, bands), jj.signatures(y, bands)))


def test_signatures_of_small_sets_at_the_threshold():
    """Sizes 8 to 17, exactly at 4/5: sets of one size and neighbours that
    differ by as much as a linked pair can."""
    r = np.random.default_rng(6)
    bands = jj.Bands(4, 5)
    missed = {}
    for a, b, common in ((8, 10, 8), (9, 9, 8), (12, 15, 12), (13, 14, 12), (14, 17, 14), (16, 17, 15)):
        assert 5 * common >= 4 * (a + b - common)
        for tokens in r.integers(0, 2**63, (6000, a + b - common), dtype=np.uint64):
            x, y = np.sort(tokens[:a]), np.sort(tokens[a - common :])
            if not np.isin(jj.signatures(x, bands), jj.signatures(y, bands)).any():
                missed[a, b] = missed.get((a, b), 0) + 1
    assert missed == {}
