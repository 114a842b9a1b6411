"""Removal of every repeated substring of ``length`` bytes or more.

A byte goes if a ``length``-byte string covering it also starts anywhere else.
The decision is made on Burrows-Wheeler transforms by threshold-bounded
interval expansion: starting from the empty string, intervals of the suffix
order are extended backward, breadth first, one character a level, and each
level fixes the common prefixes of its length; expansion stops at ``length``
and what is not fixed by then is a longer common prefix, i.e. a repeat.

No transform covers the corpus. A window of ``length`` bytes belongs to its
anchor, the k-gram in it whose first ``CHOICE`` bytes have the least hash; equal windows
have equal anchors at equal offsets, so repeats are found among the stretches
(all windows of one anchor) that share an anchor, i.e. all bytes of its k-gram. Anchors that occur once are gone after one
count; equal stretches are one row with their number; stretches that differ
are dealt by anchor into blocks of about ``BLOCK_BYTES``, each of which gets
its transform: of the windows whose hash comes again there, where cutting the
stretches down to those leaves strings that differ. An anchor with more than ``MAX_GROUP`` different stretches
does not fit a block: its windows are counted one by one by 128-bit hash, an
exact way that Spark spreads over all tasks.

What moves: one short row per anchor (about one in 70 bytes), the different
stretches, and the texts twice, compressed (to cut out stretches, to cut out repeats).

Defined cases: a null text is empty; texts shorter than ``length`` bytes
cannot repeat; overlapping occurrences in one document count; rows that repeat
a doc_id are documents of their own; a null doc_id is an id like any other;
extra columns stay. Anchors, stretches and windows are compared as hashes of
128 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch
from .text import U64, _power_table, as_signed, blocks, mix, release

LENGTH = 200
GRAM = 64
CHOICE = 24  # fewer bytes tie more often, and each tie is one more anchor
BLOCK_BYTES = 512 << 10
MAX_GROUP = 8000  # of at most 336 bytes
PIECE_BYTES = 4 << 20  # longer documents are winnowed piece by piece
_POSITION = U64((1 << 28) - 1)
_NO_ID = -(1 << 63)


# -- anchors ---------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 8 bytes from every position on."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << U64(8 * shift))
    return mix(x)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def _owners(data: np.ndarray, off: np.ndarray, length: int):
    """(8-byte hashes, first window, number of windows, anchor position, k-gram
    hash) of the anchors of a block of documents; the last four have one entry
    per anchor. None if no document has a window."""
    long = np.diff(off) >= length
    if not long.any():
        return None
    start, stop = off[:-1][long], off[1:][long] - length + 1  # windows of each document
    g = _grams(data)
    n = len(data) - GRAM + 1
    key = g[:n].copy()
    for j in range(8, CHOICE, 8):
        key = key * U64(0x9E3779B97F4A7C15) + g[j : j + n]
    key = (mix(key) & ~_POSITION) | np.arange(n, dtype=np.uint64)
    owner = _sliding_min(key, length - GRAM + 1) & _POSITION
    # windows that reach into the next document lie between a stop and a start
    edge = np.unique(np.concatenate((np.flatnonzero(owner[1:] != owner[:-1]) + 1, start, stop)))
    first, end = edge[:-1], edge[1:]
    inside = first < stop[np.searchsorted(start, first, side="right") - 1]
    inside &= first >= start[0]
    first, end = first[inside], end[inside]
    at = owner[first].astype(np.int64)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(0, GRAM, 8):
        h = h * U64(0x9E3779B97F4A7C15) + g[at + j]
    return g, first, end - first, at, mix(h)


def anchors_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The anchor hashes of a block of documents, one per anchor."""
    found = _owners(data, off, length)
    return np.zeros(0, dtype=np.int64) if found is None else as_signed(found[4])


def stretches(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, stretch hash, first window, windows) of every
    anchor of a block of documents."""
    found = _owners(data, off, length)
    if found is None:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    g, lo, count, at, h = found
    end = lo + count - 1 + length - 7  # grams inside the stretch
    pw, inv = _power_table(len(g) + 1)
    acc = np.zeros(len(g) + 1, dtype=np.uint64)
    np.cumsum(g * pw[: len(g)], out=acc[1:])
    own = mix((acc[end] - acc[lo]) * inv[lo] + mix(((at - lo) * 65536 + count).astype(np.uint64)))
    doc = np.searchsorted(off, lo, side="right") - 1
    return doc, as_signed(h), as_signed(own), lo - off[doc], count


def _parts(data: np.ndarray, off: np.ndarray, length: int):
    """(shift, bytes, offsets) of a block; a very long document comes piece by
    piece, each window in one of them."""
    if len(off) > 2 or off[-1] <= PIECE_BYTES:
        yield 0, data, off
        return
    for a in range(0, int(off[1]) - length + 1, PIECE_BYTES):
        part = data[a : a + PIECE_BYTES + length - 1]
        yield a, part, np.array([0, len(part)])


def _hash_fn(length: int):
    def fn(batches):
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                for _, part, o in _parts(data, off, length):
                    yield pa.RecordBatch.from_arrays([pa.array(anchors_of(part, o, length))], names=["anchor"])

    return fn


def _anchor_fn(length: int):
    def fn(batches):
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, _, data, off in blocks(batch.column(2)):
                for shift, part, o in _parts(data, off, length):
                    doc, anchor, own, lo, count = stretches(part, o, length)
                    if len(doc):
                        cols = [ids[i + doc], marks[i + doc], anchor, own, (lo + shift).astype(np.int32), count.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "mark", "anchor", "own", "lo", "n"])
        release()

    return fn


# -- transform and interval expansion ------------------------------------------


def _suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place) of all suffixes by their first ``depth`` symbols (prefix
    doubling). Symbol 0 ends a string; ends count as different from each
    other, so a suffix that holds one is in a place of its own."""
    n, packed = len(sym), 7
    padded = np.concatenate((sym, np.zeros(packed, dtype=sym.dtype))).astype(np.uint64)
    key, alive = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(packed):  # nothing counts behind the end of a string
        key = (key << U64(9)) | np.where(alive, padded[j : j + n], U64(0))
        alive &= padded[j : j + n] != 0
    order = np.argsort(key, kind="stable")
    sorted_key, whole = key[order], alive[order]
    head = np.ones(n, dtype=bool)
    head[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~whole[1:]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    have = packed
    while have < depth:
        single = head & np.append(head[1:], True)
        slot = np.flatnonzero(~single)
        if not len(slot):
            break
        idx = order[slot]
        key = rank[idx] * n + rank[idx + have]
        by = np.argsort(key, kind="stable")
        order[slot], key = idx[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[slot] = new
        rank[order[slot]] = np.maximum.accumulate(np.where(new, slot, 0))
        have *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, place


def repeated_windows(strings: list[bytes], times: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the starts of its ``length``-byte windows that occur
    more than once, string s standing for ``times[s]`` copies of itself."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    sym = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    sym[ends - 1] = 0
    n = len(sym)
    order, place = _suffix_order(sym, length)
    before = np.where(order > 0, sym[order - 1], 0)  # the transform
    back = place[order - 1].astype(np.int32)  # where a suffix goes when its previous symbol is put in front

    common = np.full(n + 1, -1, dtype=np.int16)  # common prefix with the suffix above; -1: not fixed yet
    common[0] = common[n] = 0
    lead = sym[order]
    head = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (lead[1:] == 0))))
    lo, hi = head, np.append(head[1:], n) - 1
    common[hi + 1] = 0
    for level in range(1, length):
        if not len(lo):
            break
        one = lo == hi
        single = lo[one]
        single = single[before[single] != 0]
        new_lo, new_hi = [back[single]], [back[single]]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo + 1
            start = np.cumsum(size) - size
            row = np.arange(size.sum()) + np.repeat(lo - start, size)
            symbol, to = before[row], back[row]
            alike = np.minimum.reduceat(symbol, start) == np.maximum.reduceat(symbol, start)
            whole = alike & (symbol[start] != 0)  # one symbol precedes all of it
            new_lo.append(np.minimum.reduceat(to, start)[whole])
            new_hi.append(np.maximum.reduceat(to, start)[whole])
            ok = np.repeat(~alike, size) & (symbol != 0)
            if ok.any():
                key, to = np.repeat(np.arange(len(lo)), size)[ok] * 512 + symbol[ok], to[ok]
                by = np.argsort(key, kind="stable")
                key, to = key[by], to[by]
                cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                new_lo.append(np.minimum.reduceat(to, cut))
                new_hi.append(np.maximum.reduceat(to, cut))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = common[hi + 1] < 0
        lo, hi = lo[fresh], hi[fresh]
        common[hi + 1] = level
    group = np.cumsum(common[:n] >= 0) - 1
    string = np.searchsorted(ends, order, side="right")
    again = np.bincount(group, weights=times[np.minimum(string, len(times) - 1)])[group] >= 2
    at = order[again]
    which = string[again]
    start = at - (ends[which] - sizes[which] - 1)
    full = start + length <= sizes[which]  # an end of a string repeats nothing
    which, start = which[full], start[full]
    by = np.lexsort((start, which))
    start = start[by]
    parts = np.searchsorted(which[by], np.arange(len(strings) + 1))
    return [start[a:b] for a, b in zip(parts[:-1], parts[1:])]


def _runs(v: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(v) != 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(v, cut) if len(p)]


def _candidates(strings: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, end) of the runs of windows whose 64-bit hash
    comes again. Equal windows have equal hashes, so no repeat lies outside."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    g = _grams(np.frombuffer(b"".join(strings), dtype=np.uint8))
    pw, inv = _power_table(len(g) + 1)
    acc = np.zeros(len(g) + 1, dtype=np.uint64)
    np.cumsum(g * pw[: len(g)], out=acc[1:])
    count = sizes - length + 1
    string = np.repeat(np.arange(len(strings)), count)
    start = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[string] + start
    h = (acc[at + length - 7] - acc[at]) * inv[at]
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
    total = np.add.reduceat(times[string[order]], head)
    again = np.zeros(len(h), dtype=bool)
    again[order] = np.repeat(total >= 2, np.diff(np.append(head, len(h))))
    turn = (again[1:] != again[:-1]) | (string[1:] != string[:-1])
    first = np.flatnonzero(again & np.concatenate(([True], turn)))
    last = np.flatnonzero(again & np.concatenate((turn, [True])))
    return string[first], start[first], start[last] + 1


def _block_ranges(keys: list[tuple[int, int]], strings: list[bytes], times: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor, own, first window, end) of the repeats of a block. Stretches
    are cut down to their candidates; what is then equal is one string, whose
    windows all repeat. An anchor goes to the transform if one of its strings
    is still alone."""
    index: dict[tuple[int, bytes], int] = {}
    sums: list[int] = []
    uses = []
    for s, x, y in zip(*(v.tolist() for v in _candidates(strings, times, length))):
        i = index.setdefault((keys[s][0], strings[s][x : y - 1 + length]), len(index))
        if i == len(sums):
            sums.append(0)
        sums[i] += int(times[s])
        uses.append((s, x, y, i))
    open_ = {anchor for (anchor, _), i in index.items() if sums[i] < 2}
    asked = [(i, piece) for (anchor, piece), i in index.items() if anchor in open_]
    found = {}
    if asked:
        windows = repeated_windows([piece for _, piece in asked], np.array([sums[i] for i, _ in asked], dtype=np.int64), length)
        found = {i: _runs(v) for (i, _), v in zip(asked, windows)}
    out = []
    for s, x, y, i in uses:
        runs = [(0, y - x)] if sums[i] >= 2 else found[i]
        out += [(*keys[s], x + a, x + b) for a, b in runs]
    return out


def _block_fn(length: int):
    def fn(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], tuple[bytes, int]] = {}
        for a, o, t, b in zip(*(table[c].to_pylist() for c in ("anchor", "own", "times", "bytes"))):
            seen[(a, o)] = (b, t)  # rows that repeat a document bring a stretch twice
        rows = _block_ranges(list(seen), [b for b, _ in seen.values()], np.array([t for _, t in seen.values()], dtype=np.int64), length)
        release()
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.table({"anchor": pa.array(cols[0], pa.int64()), "own": pa.array(cols[1], pa.int64()), "a": pa.array(cols[2], pa.int32()), "b": pa.array(cols[3], pa.int32())})

    return fn


def _pack_fn(batches):
    """Texts as they travel: compressed, a null stays null."""
    for batch in batches:
        z = zstandard.ZstdCompressor(level=3)
        at = batch.schema.get_field_index("body")
        body = pa.array([z.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays([body if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def _unpacked(body: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body.as_buffer()) if body.is_valid else b""


def _cut_stretch_fn(length: int):
    """The bytes of the stretches that stand for their kind in a document."""

    def fn(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, items in zip(batch.column("body"), batch.column("items").to_pylist()):
                raw = _unpacked(text)
                for s in items:
                    cut = raw[s["lo"] : s["lo"] + s["n"] - 1 + length]
                    for c, v in zip(out, (s["anchor"], s["own"], s["times"], s["kinds"], cut)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["anchor", "own", "times", "kinds", "bytes"])

    return fn


def _window_fn(length: int):
    """Every window of a stretch as 128-bit hash (anchors too hot for a block)."""

    def fn(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for a, o, t, b in zip(*(batch.column(c).to_pylist() for c in ("anchor", "own", "times", "bytes"))):
                for j in range(len(b) - length + 1):
                    d = hashlib.blake2b(b[j : j + length], digest_size=16).digest()
                    for c, v in zip(out, (a, o, j, t, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["anchor", "own", "a", "times", "w1", "w2"])

    return fn


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """A span made longer until it cuts no UTF-8 character."""
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(bytes left, maximal removed runs)."""
    kept, at, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            kept.append(raw[at:a])
            runs += 1
        at = max(at, b)
    kept.append(raw[at:])
    return b"".join(kept), runs


def _remove_fn():
    def fn(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for body, found in zip(batch.column("body"), batch.column("spans").to_pylist()):
                raw = _unpacked(body)
                spans = [(s["a"], s["b"]) for s in found or ()]
                left, runs = _without(raw, spans)
                text = _without(raw, [_whole(raw, a, b) for a, b in spans])[0].decode("utf-8") if spans else raw.decode("utf-8")
                for c, v in zip(cols, (raw.decode("utf-8") if body.is_valid else None, left, text, len(raw), len(raw) - len(left), runs)):
                    c.append(v)
            types = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["rest", "text", "kept", "kept_text", "n_bytes", "n_removed", "n_spans"])

    return fn


def suffix_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` as a struct ``row`` with ``kept`` (binary: the bytes left),
    ``kept_text`` (the text left: a character of which a byte goes, goes
    whole), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    scratch = Scratch(spark, "suffix")
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("body"),
    ).withColumn("mark", F.hash(F.coalesce("body", F.lit(b""))))
    packed = base.mapInArrow(_pack_fn, base.schema)
    texts = base.select("id", "mark", "body")

    anchors = texts.mapInArrow(_anchor_fn(length), "id long, mark int, anchor long, own long, lo int, n int")
    twice = texts.select("body").mapInArrow(_hash_fn(length), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    twice = scratch.keep(twice, "twice", free=True)  # a written side: Spark can split the join on a hot anchor
    shared = scratch.keep(anchors.join(twice, "anchor"), "shared", free=True)
    kinds = shared.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "mark", "lo", "n")).alias("at"))
    kinds = scratch.keep(kinds, "kinds", free=True)
    number = scratch.keep(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "numbers", free=True)
    kinds = kinds.join(number, "anchor").select("anchor", "own", "times", "kinds", "at.id", "at.mark", "at.lo", "at.n")

    # one kind of stretch, several copies: all its windows repeat
    alike = kinds.where("kinds = 1").select("anchor", "own", F.lit(0).alias("a"), F.col("n").alias("b"))
    differ = kinds.where("kinds > 1")
    total, hottest = differ.agg(F.sum(F.col("n") + length), F.max("kinds")).first()
    found = alike
    if total:
        items = differ.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "own", "times", "kinds", "lo", "n")).alias("items"))
        small = texts.mapInArrow(_pack_fn, texts.schema)
        cut = small.join(items, ["id", "mark"]).select("body", "items").mapInArrow(
            _cut_stretch_fn(length), "anchor long, own long, times long, kinds long, bytes binary"
        )
        if hottest > MAX_GROUP:  # read twice
            cut = scratch.keep(cut, "cut", free=True)
        blocks_ = max(1, -(-int(total) // BLOCK_BYTES))
        fits = cut.where(F.col("kinds") <= MAX_GROUP).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks_)))
        ranges = fits.groupBy("block").applyInArrow(_block_fn(length), "anchor long, own long, a int, b int")
        found = found.unionByName(ranges)
        if hottest > MAX_GROUP:
            hot = cut.where(F.col("kinds") > MAX_GROUP).dropDuplicates(["anchor", "own"])
            windows = hot.mapInArrow(_window_fn(length), "anchor long, own long, a int, times long, w1 long, w2 long")
            windows = scratch.keep(windows, "windows", free=True)
            again = windows.groupBy("w1", "w2").agg(F.sum("times").alias("s")).where("s > 1").select("w1", "w2")
            single = windows.join(again, ["w1", "w2"], "left_semi").select("anchor", "own", "a").distinct()
            # neighbouring windows become one range (a stretch has at most
            # length - GRAM + 1 windows)
            order = F.row_number().over(Window.partitionBy("anchor", "own").orderBy("a"))
            runs = single.withColumn("run", F.col("a") - order).groupBy("anchor", "own", "run").agg(F.min("a").alias("a"), (F.max("a") + 1).alias("b"))
            found = found.unionByName(runs.select("anchor", "own", "a", "b"))
    # one row per kind of stretch, so one per occurrence after the join
    found = found.groupBy("anchor", "own").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    found = scratch.keep(found, "ranges", free=True)
    spans = (
        shared.join(found, ["anchor", "own"])
        .select("id", "mark", F.expr(f"transform(ranges, r -> named_struct('a', lo + r.a, 'b', lo + r.b - 1 + {int(length)}))").alias("s"))
        .groupBy("id", "mark")
        .agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("spans"))
    )
    joined = packed.join(spans, ["id", "mark"], "left").select("rest", "body", "spans")
    schema = T.StructType([base.schema["rest"]]).add("text", "string").add("kept", "binary").add("kept_text", "string").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    out = joined.mapInArrow(_remove_fn(), schema)
    row = F.struct(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return out.select(row.alias("row"), "kept", "kept_text", "n_bytes", "n_removed", "n_spans")
