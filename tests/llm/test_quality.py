"""Importance resampling: held-out separation, the exact cut, odd rows."""

import numpy as np
import pytest

import brute
from tiltframe.llm import quality, text
from tiltframe.llm.quality import features, kth_largest, resample

SF = "/root/testdata/sf0.01"


def test_keeps_good_and_rejects_bad_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")  # the other half is held out
    kept = {r.doc_id for r in resample(spark, docs, half).select("row.doc_id").collect()}
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good, bad = [d for d, q in held.items() if q == 1], [d for d, q in held.items() if q == 0]
    assert np.mean([d in kept for d in good]) >= 0.99
    assert np.mean([d in kept for d in bad]) <= 0.15


def test_same_draw_however_dealt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    a = {r.doc_id for r in resample(spark, docs, labels, keep=0.3).select("row.doc_id").collect()}
    b = {r.doc_id for r in resample(spark, docs.repartition(7), labels, keep=0.3).select("row.doc_id").collect()}
    assert a == b and len(a) == 300


@pytest.mark.parametrize("values", [[3.0, -1.5, 3.0, 0.0, -0.0, 1e300, -1e300, 5e-324], [-2.0], [7.0] * 9])
def test_kth(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in range(1, len(values) + 1):
        assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, len(values) + 1) is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words", 1), (1, "good words", 1), (2, None, 1), (3, "", 1), (None, "bad", 1), (4, "x " * 30000, 1)], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (3, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    out = resample(spark, docs, labels, keep=1.0)
    assert out.count() == 6 and out.select("row.key").distinct().count() == 1
    assert resample(spark, docs, labels.limit(0)).count() == 6
    assert resample(spark, docs.limit(0), labels).count() == 0
    assert resample(spark, docs, labels, keep=0.0).count() == 0


def _plain(docs, labels, share):
    values = [int(v) for v in text._BYTE_VALUE]
    return brute.resample(docs, labels, share, quality.SEED, values, text._BASE, int(quality._RUN), quality.BUCKETS, quality.SMOOTHING)


def _same(got, want):
    key = lambda r: (str(r[0]), r[1] or "", r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-9, atol=1e-9)


def _rows(df):
    return [(r.row.doc_id, r.row.text, r.log_weight, r.key) for r in df.collect()]


@pytest.mark.parametrize("share", [0.05, 0.4, 1.0])
def test_weights_keys_and_draw_are_brute_force(spark, share):
    """Real texts with repeated rows (they tie), one-word, null, empty and long ones."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(400).collect()]
    docs += docs[:30] + [docs[0]] * 40 + [(docs[0][0], "another text"), (None, "Same same SAME"), (None, None), (9001, ""), (9002, "word"), (9003, "é 日本 é é"), (9004, "x y " * 20000)]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()] + [(9002, 1), (9004, 0), (None, 1), (9003, None)]
    every, drawn = _plain(docs, labels, share)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    _same(_rows(resample(spark, a.repartition(5), b, keep=share)), drawn)
    if share == 1.0:
        assert len(drawn) == len(every) == len(docs)


def test_default_share_is_that_of_good_labels(spark):
    docs = [(i, f"good words {i}" if i % 4 == 0 else f"bad noise {i}") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(100)]
    drawn = _plain(docs, labels, 0.25 + quality.MARGIN)[1]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    _same(_rows(resample(spark, a, b)), drawn)


def test_one_word_has_one_bucket_however_dealt():
    """A block that holds a single word gives the bucket any block gives."""
    alone = np.frombuffer(b"word", dtype=np.uint8)
    both = np.frombuffer(b"wordother", dtype=np.uint8)
    one, _ = features(alone, np.array([0, 4]), 1 << 16)
    two, doc = features(both, np.array([0, 4, 9]), 1 << 16)
    assert one.tolist() == two[doc == 0].tolist()
    none, _ = features(alone[:0], np.array([0, 0]), 1 << 16)
    assert len(none) == 0
