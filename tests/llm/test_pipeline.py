"""The corpus pipeline, stage by stage against brute force, and odd inputs."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import brute
import corpus_pipeline as cp
from conftest import SF_SMALL

COLUMNS = list(cp.COLUMNS)


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = cp.quality(spark, docs, SF_SMALL).cache()
    assert one.columns == COLUMNS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in one.collect()}
    assert len({d for d, q in labels.items() if q == 1} - kept) <= 2
    two = cp.lines(spark, one, SF_SMALL).cache()
    assert sorted(_pairs(two)) == sorted((d, t) for d, _, _, t in brute.line_dedup(_pairs(one)))
    three = cp.near_copies(spark, two, SF_SMALL).cache()
    groups = {d: c for d, _, c in brute.near_duplicates(_pairs(two), 5, 4, 5)}
    assert sorted(d for d, _ in _pairs(three)) == sorted(set(groups.values()))
    four = cp.substrings(spark, three, SF_SMALL).cache()
    want = {d: h for d, _, _, _, h in brute.substring_dedup(_pairs(three))}
    got = {d: brute.sha(t.encode()) for d, t in _pairs(four)}
    before = dict(_pairs(three))
    assert got.keys() == want.keys()
    assert all(got[d] == want[d] for d in got if before[d].isascii())
    assert all(r.n_chars == len(r.text) for r in four.collect())
    assert {tuple(x.columns) for x in (two, three, four)} == {tuple(COLUMNS)}
    tok, by_doc = Tokenizer.from_file(cp.BYTE_BPE), defaultdict(list)
    for r in cp.packing(spark, four, SF_SMALL).collect():
        by_doc[r.doc_id].append(r)
    for d, t in _pairs(four):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert sum(r.length for r in by_doc[d]) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in by_doc[d])
    for x in (one, two, three, four):
        x.unpersist()


def test_odd_documents(spark):
    long = "word " * 20000
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, None), (3, long, None, "s", 1), (3, long, None, "s", 1), (None, "text without id " * 30, "en", "s", 1), (4, "é" * 500, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            d = stage(spark, d, SF_SMALL)
            assert d.columns == COLUMNS, name
            d = spark.createDataFrame(d.collect(), docs.schema)
        cp.packing(spark, d, SF_SMALL).count()
