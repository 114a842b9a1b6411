"""Quality selection by importance resampling over hashed n-grams.

Two generative bag models over hashed word unigrams and bigrams (``BUCKETS``
buckets) are estimated: one of the target (texts labelled good), one of the
raw corpus, which also smooths the target's. A document's importance weight is the ratio of its likelihoods;
the resample of size k without replacement takes the k largest log weights
plus Gumbel noise. The noise comes from a hash of the doc_id, so a rerun, or a
task run again after a lost executor, draws the same sample.

Passes: one counts n-grams (every text; what leaves a task is at most one row
per bucket), one scores every text for the cut, one scores again and filters,
so texts are never shuffled. The cut is the exact k-th largest key, found by
counting keys digit by digit (65,536 counters a round). The target model is
fitted on at most ``MAX_TARGET`` labelled texts, chosen by hash; their ids
are the only rows that are broadcast.

Defined cases: a null or empty text has weight 0 (log) and can be drawn by its
noise; rows that repeat a doc_id draw the same noise and each fills a place;
keys that tie with the k-th are all kept; a null doc_id draws noise like any
id; labels that are null, contradictory or of unknown ids are not used; without
any usable label every row is kept; extra columns stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch
from .text import U64, blocks, mix, ngrams, words

BUCKETS = 1 << 16
MAX_TARGET = 20_000
#: Counts by which a bucket's ratio is drawn towards 1.
SMOOTHING = 20.0
#: Drawn beyond the share of good texts: labels are a sample.
MARGIN = 0.01
SEED = 11
_RUN = U64(0x6A09E667F3BCC909)  # stands for "the word before, again"


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, document of each n-gram) of a block. A word
    that repeats its predecessor gives one common bigram, whatever the word."""
    h, wo = words(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(wo))
    two = ngrams(h, 2)
    two = np.where(h[1:] == h[:-1], _RUN, two)
    same = doc[1:] == doc[:-1]
    both = np.concatenate((h, two[same]))
    return (mix(both) % U64(buckets)).astype(np.int64), np.concatenate((doc, doc[1:][same]))


def _count_fn(buckets: int):
    def fn(batches):
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for i, j, data, off in blocks(batch.column(0)):
                b, doc = features(data, off, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[i:j][doc]], minlength=buckets)
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], names=["bucket", "raw", "target"])

    return fn


def _score_fn(ratio: np.ndarray, seed: int):
    buckets = len(ratio)

    def fn(batches):
        for batch in batches:
            n = batch.num_rows
            weight = np.zeros(n)
            for i, j, data, off in blocks(batch.column(batch.schema.get_field_index("body"))):
                b, doc = features(data, off, buckets)
                weight[i:j] = np.bincount(doc, weights=ratio[b], minlength=j - i)
            draw = batch.column(batch.schema.get_field_index("draw")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            u = ((mix(draw ^ U64(seed)) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = weight - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key)], names=[batch.schema.names[0], "log_weight", "key"])

    return fn


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the double column ``key``, by counting the 16-bit
    digits of its order-preserving bit pattern; None if there are fewer."""
    bits = F.expr("CASE WHEN b < 0 THEN b ^ 9223372036854775807 ELSE b END")  # as a signed number
    digits = keys.select(F.expr("key + 0.0").alias("key"))
    digits = digits.mapInArrow(_bits_fn, "b long").select(bits.alias("s"))
    known, left = 0, k
    for shift in (48, 32, 16, 0):
        part = digits if shift == 48 else digits.where(F.shiftright("s", shift + 16) == F.lit(known))
        digit = F.shiftright("s", shift) if shift == 48 else F.shiftright("s", shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(((int(r["digit"]), int(r["n"])) for r in part.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for value, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None
        known = value if shift == 48 else (known << 16) | value
    b = known ^ 0x7FFFFFFFFFFFFFFF if known < 0 else known
    return float(np.array([b], dtype=np.int64).view(np.float64)[0])


def _bits_fn(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64))], names=["b"])


def resample(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", keep: float | None = None, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """The drawn rows of ``docs`` as a struct ``row`` with ``log_weight`` and
    ``key``. ``keep`` is the share to draw; by default the share of good texts
    among the labelled ones and ``MARGIN``."""
    scratch = Scratch(spark, "quality")
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    marks = marks.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = hi")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
    ).withColumn("draw", F.xxhash64("id"))
    good = marks.where("hi > 0").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(MAX_TARGET).select(F.col("id").alias("good"))
    counted = base.join(F.broadcast(good), base["id"] == F.col("good"), "left").select("body", F.col("good").isNotNull().alias("is_good"))
    counts = counted.mapInArrow(_count_fn(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # at most one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING))
    if not target.sum():
        ratio[:] = 0.0
    share = keep
    if share is None:
        n, hits = marks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("hi") > 0, 1).otherwise(0))).first()
        share = min(1.0, hits / n + MARGIN) if n else 1.0
    scores = scratch.keep(
        base.select(F.col("id"), "body", "draw").mapInArrow(_score_fn(ratio, seed), "id long, log_weight double, key double").select("key"), "keys"
    )
    k = math.ceil(share * scores.count() - 1e-9)
    cut = kth_largest(scores, k) if k else math.inf
    schema = T.StructType([base.schema["row"]]).add("log_weight", "double").add("key", "double")
    scored = base.select("row", "body", "draw").mapInArrow(_score_fn(ratio, seed), schema)
    return scored if cut is None else scored.where(F.col("key") >= F.lit(cut))
