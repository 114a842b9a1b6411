"""Packing documents into fixed-length training sequences (cutting stock).

1. One pass tokenizes every document (byte-level BPE, then the end id) and
   cuts it at multiples of the sequence length, and the rest at half a
   sequence if it is longer; what leaves the task is one short row per piece.
2. Spark counts the pieces per length: at most ``SEQ_LEN`` rows, whatever the
   input. On this histogram the driver solves the cutting-stock linear program
   by column generation: a column is a pattern of lengths, its cost is what
   the sequence is padded to, and a knapsack dynamic program over the duals
   prices new patterns.
3. Patterns are used as often as the program says, rounded down; the pieces
   left over (at most some per pattern: bounded by the histogram too) are
   packed first-fit decreasing.
4. Pieces are ranked within their length and meet the pattern slots by rank.
   The rank comes from per-bucket counts and a running number inside a bucket,
   so a length that a third of all pieces share is split over many tasks. The
   slot table is bounded by lengths x patterns and is broadcast.

Defined cases: a null text is empty, so its document is the end id alone;
repeated rows are packed one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .tokenizers_io import byte_encoder, read_tokenizer

SEQ_LEN = 1024
END_ID = 0
#: Pieces in one rank bucket of one length.
BUCKET_PIECES = 50_000
#: The program is solved when it is this close to a lower bound (share of it).
GAP = 1e-4
#: It also ends when this many pricings together gain less than that.
PATIENCE = 64
#: Weight of the lengths against the duals when new patterns are priced.
TRUST = 0.9

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, seq_len: int = SEQ_LEN) -> list[tuple[int, int]]:
    """Pieces of a document of ``n`` tokens: full sequences, then half a
    sequence if the rest is longer (two long rests would not share a
    sequence), then the rest."""
    at = list(range(0, n + 1, seq_len))
    if n - at[-1] > seq_len // 2:
        at.append(at[-1] + seq_len // 2)
    if at[-1] < n:
        at.append(n)
    return list(zip(at, at[1:]))


def _piece_fn(spec: str, seq_len: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def fn(batches):
        bpe = byte_encoder(spec)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start, end_at in cuts(n, seq_len):
                    piece = ids[4 * start : 4 * end_at]
                    for c, v in zip(cols, (doc_id, start, end_at - start, zlib.crc32(piece), n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return fn


def padded_size(total: int, seq_len: int = SEQ_LEN) -> int:
    """Tokens a sequence of ``total`` tokens takes: itself at a power of two,
    else the full length."""
    return total if total & (total - 1) == 0 else seq_len


class _Prices:
    """Knapsack over the duals: the worth of the best pattern of each total."""

    def __init__(self, lengths: np.ndarray, seq_len: int):
        self.lengths, self.seq_len = lengths, seq_len
        self.cost = np.array([0] + [padded_size(t, seq_len) for t in range(1, seq_len + 1)], dtype=float)

    def patterns(self, duals: np.ndarray, most: int) -> list[np.ndarray]:
        worth = np.full(self.seq_len + 1, -np.inf)
        worth[0], last = 0.0, np.zeros(self.seq_len + 1, dtype=np.int64)
        upto = np.searchsorted(self.lengths, np.arange(self.seq_len + 1), side="right")
        for t in range(1, self.seq_len + 1):
            if upto[t]:
                v = duals[: upto[t]] + worth[t - self.lengths[: upto[t]]]
                last[t] = k = int(np.argmax(v))
                worth[t] = v[k]
        gain = worth - self.cost
        dearest = float((worth[1:] / self.cost[1:]).max(initial=0.0))
        out = []
        for t in np.argsort(-gain)[:most].tolist():
            if gain[t] <= 1e-7 * self.seq_len:
                break
            a = np.zeros(len(self.lengths))
            while t > 0:
                a[last[t]] += 1
                t -= int(self.lengths[last[t]])
            out.append(a)
        return out, dearest


def solve(histogram: dict[int, int], seq_len: int = SEQ_LEN, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: count}, times used)] covering the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []
    for n in [n for n in left if padded_size(n, seq_len) == n == seq_len]:
        out.append(({n: 1}, left.pop(n)))  # full pieces fill a sequence alone
    if left:
        lengths = np.array(sorted(left), dtype=np.int64)
        need = np.array([left[n] for n in lengths.tolist()], dtype=float)
        for pattern, used in _column_generation(lengths, need, seq_len, gap):
            fits = min([int(used + 1e-9)] + [left[n] // c for n, c in pattern.items()])
            if fits > 0:
                out.append((pattern, fits))
                for n, c in pattern.items():
                    left[n] -= c * fits
        out.extend(_first_fit(left, seq_len))
    return out


def _first_basis(lengths, need, seq_len):
    """Greedy patterns, each used (fractionally) until one of its lengths is
    used up: later patterns do not hold that length, so the columns form a
    triangular, feasible basis. Returns (basis, its inverse, times used)."""
    m = len(lengths)
    left, alive = need.copy(), np.ones(m, dtype=bool)
    basis, times = np.zeros((m, m)), np.zeros(m)
    ends = np.zeros(m, dtype=np.int64)  # the length that pattern j uses up
    for j in range(m):
        room, a = seq_len, np.zeros(m)
        for i in np.flatnonzero(alive)[::-1].tolist():
            if lengths[i] > room:
                continue
            k = min(room // int(lengths[i]), max(1, int(left[i])))
            a[i], room = k, room - k * int(lengths[i])
            if room == 0:
                break
        used = a > 0
        ratio = np.where(used, left / np.where(used, a, 1.0), np.inf)
        r = int(np.argmin(ratio))
        times[j], basis[:, j], ends[j] = ratio[r], a, r
        left = np.maximum(left - ratio[r] * a, 0.0)
        alive[r] = False
    lower, inverse = basis[ends], np.zeros((m, m))  # row i: the length used up by pattern i
    for i in range(m):
        inverse[i] = -np.einsum("j,jk->k", lower[i, :i], inverse[:i])
        inverse[i, ends[i]] += 1.0
        inverse[i] /= lower[i, i]
    return basis, inverse, times


def _column_generation(lengths, need, seq_len, gap):
    """Revised simplex on min cost x, A x = need, from greedy patterns.
    Lengths themselves are feasible duals (no pattern costs less than its
    tokens), so pricing looks between them and the current duals, nearer to
    the latter when that finds no pattern. It ends when no pattern has a
    negative reduced cost, when ``PATIENCE`` pricings gain next to nothing (a
    degenerate program turns on the spot), or when the cost is within ``gap`` of a lower bound
    (or a quarter of a sequence: rounding to whole sequences costs more): the
    tokens, or the duals scaled down until every pattern pays for them."""
    bound = float(lengths @ need)
    prices = _Prices(lengths, seq_len)
    basis, inverse, x = _first_basis(lengths, need, seq_len)
    cost = np.array([padded_size(int(t), seq_len) for t in lengths @ basis], dtype=float)
    trust, priced, before = TRUST, 0, np.inf
    while cost @ x > bound + max(gap * bound, seq_len / 4):
        if priced % PATIENCE == 0:
            if before - cost @ x < gap * bound:
                break
            before = cost @ x
        priced += 1
        duals = np.einsum("j,jk->k", cost, inverse)
        moved = 0
        mixed = trust * lengths + (1 - trust) * duals
        found, dearest = prices.patterns(mixed, 48)
        bound = max(bound, float(mixed @ need) / max(1.0, dearest))
        for a in found:
            c = float(padded_size(int(a @ lengths), seq_len))
            if c - duals @ a > -1e-7 * seq_len:
                continue
            d = np.einsum("jk,k->j", inverse, a)
            up = d > 1e-6
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, d, 1.0), np.inf)
            r = int(np.argmin(ratio))
            x = np.maximum(x - ratio[r] * d, 0.0)
            x[r] = ratio[r]
            row = inverse[r] / d[r]
            duals = duals + (c - duals @ a) * row
            inverse -= np.outer(d, row)
            inverse[r] = row
            basis[:, r], cost[r] = a, c
            moved += 1
        if not moved:
            if trust == 0.0:
                break
            trust = 0.0 if trust < 0.05 else trust / 2
    # what rounding errors leave out of the counts goes to first-fit
    for r in np.argsort(-x, kind="stable").tolist():
        k = np.flatnonzero(basis[:, r])
        yield {int(lengths[i]): int(basis[i, r]) for i in k.tolist()}, float(x[r])


def _first_fit(left: dict[int, int], seq_len: int):
    """First-fit decreasing over what rounding left."""
    size = sorted((n for n, c in left.items() if c > 0), reverse=True)
    left = dict(left)
    while size:
        room, pattern = seq_len, {}
        for n in size:
            k = min(left[n], room // n)
            if k:
                pattern[n], room, left[n] = k, room - n * k, left[n] - k
        yield pattern, 1
        size = [n for n in size if left[n]]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence,
    first offset): which ranks of a length go where."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, used in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            a = pattern[n]
            lo = rank.get(n, 0)
            rank[n] = lo + a * used
            rows.append((n, lo, rank[n], a, seq, offset))
            offset += n * a
        seq += used
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spec = read_tokenizer(tokenizer_path)
    scratch = Scratch(spark, "packing")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = scratch.keep(src.mapInArrow(_piece_fn(spec, seq_len, end_id), PIECES), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(
        slots(solve(counts, seq_len)), "length long, lo long, hi long, per_seq long, first_seq long, first_offset long"
    )
    buckets = max(1, -(-sum(counts.values()) // BUCKET_PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("i", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("i"))
    )
    at = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return at.select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        (F.col("first_seq") + F.floor(k / F.col("per_seq"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(k, F.col("per_seq")) * ranked["length"]).cast("long").alias("offset"),
    )
