"""BPE and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import tiltframe.llm.bpe as bpe
import tiltframe.llm.packing as packing
from conftest import SF_SMALL
from tiltframe.llm.queries import BYTE_BPE, WORD_BPE
from tiltframe.llm.tokenizers_io import byte_encoder, read_tokenizer

ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "Hello <|endoftext|>World's I'LL  don't"), (5, "ÅΣΑΣ İstanbul ŉ ﬁ ſ é x\u0085y z \x1c\x1d q"),
    (6, "x" * 50000), (7, "日本語 テスト 123४५ ½²"), (8, "<|startoftext|><|endoftext|>a"), (9, "a​b 　c ﻿d"), (10, "😀😀 👨‍👩‍👧 !!!???"),
    (10, "again"), (None, "no id"),
]


def _real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("chunk", [None, 50])
def test_word_bpe(spark, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(bpe, "CHUNK_WORDS", chunk)
    tok = Tokenizer.from_file(WORD_BPE)
    docs = ODD + _real(spark)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, chunk int")
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.bpe_encode(spark, df, WORD_BPE).collect()), key=str)
    want = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, dtype="<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_encode(spark, empty, WORD_BPE).count() == 0
    assert packing.pack(spark, empty, BYTE_BPE).count() == 0


def test_byte_ids(spark):
    tok, fast = Tokenizer.from_file(BYTE_BPE), byte_encoder(read_tokenizer(BYTE_BPE))
    for _, t in ODD + _real(spark):
        assert fast.ids(t or "") == np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing(spark):
    tok = Tokenizer.from_file(BYTE_BPE)
    docs = [d for d in ODD if d[0] not in (10, None)] + [(1000 + d, t) for d, t in _real(spark)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    rows = packing.pack(spark, df, BYTE_BPE).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in docs:
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    total = padded = 0
    for many in by_seq.values():
        at = 0
        for r in sorted(many, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, padded = total + at, padded + packing.padded_size(at)
    assert padded <= 1.02 * total


def test_repeated_rows_are_packed_one_by_one(spark):
    rows = packing.pack(spark, spark.createDataFrame([(1, "same text here")] * 5, "doc_id long, text string"), BYTE_BPE).collect()
    assert len(rows) == 5 and len({(r.sequence_id, r.offset) for r in rows}) == 5


@pytest.mark.parametrize("seed", range(6))
def test_solver_covers_the_histogram(seed):
    r = random.Random(seed)
    lengths = r.sample(range(1, 513), r.choice([1, 2, 30, 200])) + [1024]
    h = {n: r.choice([1, 2, 50, 4000]) for n in lengths}
    used = defaultdict(int)
    padded = 0
    for pattern, times in packing.solve(h):
        size = sum(n * c for n, c in pattern.items())
        assert size <= 1024 and times > 0
        padded += packing.padded_size(size) * times
        for n, c in pattern.items():
            used[n] += c * times
    assert used == h
    at = defaultdict(int)
    for n, lo, hi, per, _, _ in packing.slots(packing.solve(h)):
        assert lo == at[n] and (hi - lo) % per == 0
        at[n] = hi
    assert at == h


def test_columns_are_priced(monkeypatch):
    """Lengths of many documents: the program runs, and ends near its bound."""
    r = random.Random(1)
    h = Counter(min(512, int(r.lognormvariate(5, 1)) + 1) for _ in range(20000))
    calls, plain = [], packing._Prices.patterns
    monkeypatch.setattr(packing._Prices, "patterns", lambda *a: calls.append(1) or plain(*a))
    solved = packing.solve(dict(h))
    tokens = sum(n * c for n, c in h.items())
    assert calls and sum(packing.padded_size(sum(n * c for n, c in p.items())) * t for p, t in solved) <= 1.001 * tokens


def test_cuts():
    for n in (1, 511, 512, 513, 1023, 1024, 1025, 1536, 1537, 5000):
        c = packing.cuts(n)
        assert c[0][0] == 0 and c[-1][1] == n and all(a[1] == b[0] for a, b in zip(c, c[1:]))
        assert all(b - a == 1024 or b - a <= 512 for a, b in c)
