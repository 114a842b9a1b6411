"""Removal of every passage of ``length`` words that occurs earlier.

A word goes if a window of ``length`` words covering it also starts earlier
(smaller doc_id, or same doc_id and earlier word). Windows that recur are
confirmed as phrases, compiled into Aho-Corasick automata (pyahocorasick, the
words as letters), and the documents' words are streamed through them to
locate every occurrence; the least location of a phrase stays.

No automaton covers the corpus, and no document visits more than the automata
it may match. A window belongs to its anchor, the run of ``GRAM`` words of least
hash in it: equal windows have equal anchors. All windows of one anchor in a
document are a stretch. The steps:

1. Anchors are counted (map-side combined); stretches of an anchor that occurs
   once hold no recurring window and go no further.
2. Equal stretches are one row with their number and first place, so a passage
   that a third of all documents share is a row, not a group. Their words are
   cut out of the document of that first place.
3. Stretches are dealt by anchor into shards of about ``SHARD_WINDOWS``
   windows. An anchor with more than ``MAX_KINDS`` different stretches (a short
   phrase in ever new surroundings) is dealt by window instead, equal windows
   again as one row. A shard confirms its phrases (windows met twice or more),
   compiles its automaton and streams its stretches through it.
4. What was located goes back to every copy of a stretch by its key, to the
   documents by position, and the words left are joined by one space.

What moves: one short row per anchor (about one in 8 words), the different
stretches that may recur, and the texts twice (to cut out, to put together).

Defined cases: a null or empty text has no words; a text of fewer than
``length`` words has no window; overlapping occurrences in one document count;
rows that repeat a doc_id are judged by (doc_id, first word) alone, so equal
rows of one doc_id do not take from each other; a null doc_id ranks below every
other; texts of any length are taken whole (long ones piece by piece); extra
columns stay, those of the result's names are replaced; an empty table gives an
empty result. Stretches are told apart by hashes of 128 bits, phrases word by
word.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch
from .text import _IS_SPACE, SPACE_BYTES, U64, _power_table, as_signed, blocks, mix, ngrams, release, words

LENGTH = 20
GRAM = 6
SHARD_WINDOWS = 20_000
MAX_KINDS = 500
PIECE_BYTES = 4 << 20  # longer documents are read piece by piece
_POSITION = U64((1 << 28) - 1)
_NO_ID = -(1 << 63)


# -- words and stretches -----------------------------------------------------


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a run of bytes."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _parts(data: np.ndarray, off: np.ndarray, length: int):
    """(first word, bytes, offsets) of a block; a very long document comes piece
    by piece, each window in one of them."""
    if len(off) > 2 or off[-1] <= PIECE_BYTES:
        yield 0, data, off
        return
    n, at, shift, size = int(off[1]), 0, 0, PIECE_BYTES
    while at < n:
        end = min(n, at + size)
        while end < n and not _IS_SPACE[data[end]]:  # to the end of a word
            stop = np.flatnonzero(_IS_SPACE[data[end : end + 4096]])
            end = end + int(stop[0]) if len(stop) else min(n, end + 4096)
        starts, _ = word_bounds(data[at:end])
        if len(starts) < length and end < n:
            size *= 2  # words of this size: a larger piece
            continue
        yield shift, data[at:end], np.array([0, end - at])
        if end == n:
            return
        back = len(starts) - length + 1  # the next piece starts with the next window
        at, shift, size = at + int(starts[back]), shift + back, PIECE_BYTES


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def stretches(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, stretch hash, first window, windows) of every
    stretch of a block of documents."""
    h, wo = words(data, off, lower=False)
    place = np.arange(len(h))
    window = place[place + length <= np.repeat(wo[1:], np.diff(wo))]
    if not len(window):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    g = ngrams(h, gram)
    key = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
    owner = (_sliding_min(key, length - gram + 1)[window] & _POSITION).astype(np.int64)
    doc = np.searchsorted(wo, window, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(new, len(owner)))
    lo, at, doc = window[new], owner[new], doc[new]
    end = lo + count - 1 + length
    pw, inv = _power_table(len(h) + 1)
    acc = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * pw[: len(h)], out=acc[1:])
    own = mix((acc[end] - acc[lo]) * inv[lo] + mix(((at - lo) * 65536 + count).astype(np.uint64)))
    return doc, as_signed(g[at]), as_signed(own), lo - wo[doc], count


def _anchor_fn(length: int):
    def fn(batches):
        for batch in batches:
            for i, _, data, off in blocks(batch.column("body")):
                for _, part, po in _parts(data, off, length):
                    anchors = stretches(part, po, length)[1]
                    seen, times = np.unique(anchors, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["anchor", "c"])
        release()

    return fn


def _stretch_fn(length: int):
    def fn(batches):
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark"))
            for i, _, data, off in blocks(batch.column("body")):
                for shift, part, po in _parts(data, off, length):
                    doc, anchor, own, lo, n = stretches(part, po, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i + doc]), pa.array(marks[i + doc]), pa.array(anchor), pa.array(own), pa.array(lo + shift), pa.array(n.astype(np.int32))],
                        names=["id", "mark", "anchor", "own", "lo", "n"],
                    )
        release()

    return fn


def _cut_fn(length: int):
    """The words of each item (first window, windows) of a document."""
    names = ["anchor", "own", "times", "kinds", "id", "lo", "n", "words"]

    def fn(batches):
        for batch in batches:
            for ident, body, items in zip(batch.column("id").to_pylist(), batch.column("body"), batch.column("items")):
                raw = body.as_buffer().to_pybytes()
                starts, ends = word_bounds(np.frombuffer(raw, dtype=np.uint8))
                item = items.values
                col = {f: item.field(f) for f in ("anchor", "own", "times", "kinds", "lo", "n")}
                lo, n = (col[f].to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "n"))
                spell = [raw[a:b] for a, b in zip(starts[lo].tolist(), ends[lo + n + length - 2].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(col[c] for c in names[:4]), pa.array(np.full(len(lo), ident, dtype=np.int64)), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(spell, pa.binary())],
                    names=names,
                )

    return fn


def _window_fn(length: int):
    """Each window of a stretch by itself, with a 128-bit hash of its words."""

    def fn(batches):
        for batch in batches:
            for r in batch.to_pylist():
                parts = r["words"].split()  # at ASCII white space
                spell = [b" ".join(parts[a : a + length]) for a in range(r["n"])]
                data = np.frombuffer(r["words"], dtype=np.uint8)
                h, _ = words(data, np.array([0, len(data)]), lower=False)
                w1 = as_signed(ngrams(h, length))
                w2 = as_signed(mix(ngrams(mix(h + U64(0x5851F42D4C957F2D)), length)))
                k = r["n"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["anchor"]] * k, pa.int64()), pa.array([r["own"]] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([r["times"]] * k, pa.int64()),
                     pa.array([r["id"]] * k, pa.int64()), pa.array([r["lo"] + a for a in range(k)], pa.int64()), pa.array(w1[:k]), pa.array(w2[:k]), pa.array(spell, pa.binary())],
                    names=["anchor", "own", "a", "times", "id", "lo", "w1", "w2", "words"],
                )

    return fn


# -- automata -----------------------------------------------------------------


def locate(stream: list[list[bytes]], times, kinds, places, length: int = LENGTH) -> list[tuple[list[int], list[int]]]:
    """Phrases of a shard located in its word lists. ``times``: how often each
    list occurs, ``kinds``: how many different lists share its anchor,
    ``places``: its first (doc_id, word). Per list: the windows that hold a
    phrase, and those of them that its first copy does not hold first.

    The windows of a list that is alone with its anchor recur together: the
    list is one phrase. Else every window met twice or more is one."""
    letter: dict[bytes, int] = {}
    spelled = [tuple([letter.setdefault(w, len(letter)) for w in ws]) for ws in stream]
    count: Counter = Counter()
    for ws, t, k in zip(spelled, times, kinds):
        if k == 1:
            count[ws] += t
        else:
            for a in range(len(ws) - length + 1):
                count[ws[a : a + length]] += t
    phrases = [p for p, c in count.items() if c > 1]
    if not phrases:
        return [([], [])] * len(stream)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    size = [len(p) for p in phrases]
    hits, first = [], [None] * len(phrases)
    for ws, (ident, lo) in zip(spelled, places):
        mine = [(end - size[p] + 1, p) for end, p in automaton.iter(ws)]
        hits.append(mine)
        for a, p in mine:
            here = (ident, lo + a)
            if first[p] is None or here < first[p]:
                first[p] = here

    def windows(found):
        return [b for a, p in found for b in range(a, a + size[p] - length + 1)]

    return [(windows(mine), windows([(a, p) for a, p in mine if first[p] != (ident, lo + a)])) for mine, (ident, lo) in zip(hits, places)]


def _shard_fn(length: int):
    """(anchor, own, offsets of located windows, those not first) per stretch."""

    def fn(table: pa.Table) -> pa.Table:
        stream = [w.split() for w in table.column("words").to_pylist()]
        places = list(zip(table.column("id").to_pylist(), table.column("lo").to_pylist()))
        found = locate(stream, *(table.column(c).to_pylist() for c in ("times", "kinds")), places, length)
        keep = [i for i, (every, _) in enumerate(found) if every]
        ints = pa.list_(pa.int32())
        return pa.table({
            "anchor": table.column("anchor").take(pa.array(keep, pa.int64())),
            "own": table.column("own").take(pa.array(keep, pa.int64())),
            "every": pa.array([found[i][0] for i in keep], ints),
            "later": pa.array([found[i][1] for i in keep], ints),
        })

    return fn


# -- the words that stay ---------------------------------------------------------


def without(raw: bytes, windows, length: int) -> tuple[bytes, int, int]:
    """(kept words joined by one space, words, words removed)."""
    stay = None
    if len(windows):
        at = np.unique(np.asarray(windows, dtype=np.int64))
        step = np.zeros(int(at[-1]) + length + 1, dtype=np.int64)
        step[at] += 1
        step[at + length] -= 1
        stay = (np.cumsum(step) == 0).tolist()
    n, kept, pieces, at = 0, 0, [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw) and raw[end] not in SPACE_BYTES:  # to the end of a word
            end += 1
        ws = raw[at:end].split()
        left = ws
        if stay is not None and n < len(stay):
            left = [*compress(ws, stay[n : n + len(ws)]), *ws[max(0, len(stay) - n) :]]
        if left:
            pieces.append(b" ".join(left))
        n, kept, at = n + len(ws), kept + len(left), end
    return b" ".join(pieces), n, n - kept


def _remove_fn(text_col: str, length: int):
    def fn(batches):
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text_col).cast(pa.large_binary())
            out: list[list] = [[], [], []]
            for body, windows in zip(texts, batch.column("windows")):
                raw = body.as_buffer().to_pybytes() if body.is_valid else b""
                kept, n, gone = without(raw, windows.values.to_numpy() if windows.is_valid else (), length)
                for c, v in zip(out, (kept.decode("utf-8"), n, gone)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([row, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["row", "kept", "n_words", "n_removed"])

    return fn


def phrase_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one space),
    ``n_words`` and ``n_removed``."""
    scratch = Scratch(spark, "phrases")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.hash(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("mark"),
    )
    texts = base.select("id", "mark", F.col("row")[text_col].cast("binary").alias("body")).where("body IS NOT NULL")

    counts = texts.select("body").mapInArrow(_anchor_fn(length), "anchor long, c long")
    twice = counts.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor")
    twice = scratch.keep(twice, "twice", free=True)  # a written side: Spark can split the join on a hot anchor
    every = texts.mapInArrow(_stretch_fn(length), "id long, mark int, anchor long, own long, lo long, n int")
    shared = scratch.keep(every.join(twice, "anchor"), "shared", free=True)
    kinds = shared.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "lo", "mark", "n")).alias("at"))
    kinds = scratch.keep(kinds, "kinds", free=True)
    number = scratch.keep(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")).where(F.col("all") > 1), "numbers", free=True)
    kinds = kinds.join(number, "anchor").select("anchor", "own", "times", "kinds", "at.id", "at.lo", "at.mark", "at.n")

    items = kinds.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "own", "times", "kinds", "lo", "n")).alias("items"))
    # rows that repeat id and text hold the same words: one of them is cut
    cut = texts.join(items, ["id", "mark"]).mapInArrow(_cut_fn(length), "anchor long, own long, times long, kinds long, id long, lo long, n int, words binary")
    cut = scratch.keep(cut.dropDuplicates(["anchor", "own"]), "cut", free=True)
    total, hottest = cut.agg(F.sum("n"), F.max("kinds")).first()
    shards = max(1, -(-int(total or 0) // SHARD_WINDOWS))
    located = "anchor long, own long, every array<int>, later array<int>"
    fits = cut.where(F.col("kinds") <= MAX_KINDS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = fits.groupBy("shard").applyInArrow(_shard_fn(length), located)
    if (hottest or 0) > MAX_KINDS:
        found = found.unionByName(_by_window(cut.where(F.col("kinds") > MAX_KINDS), length, shards, scratch))
    found = scratch.keep(found, "found", free=True)

    first = kinds.select("anchor", "own", F.col("id").alias("id0"), F.col("lo").alias("lo0"))
    found = scratch.keep(found.join(first, ["anchor", "own"]), "located", free=True)
    mine = F.when((F.col("id") == F.col("id0")) & (F.col("lo") == F.col("lo0")), F.col("later")).otherwise(F.col("every"))
    gone = (
        shared.select("anchor", "own", "id", "mark", "lo").join(found, ["anchor", "own"])
        .select("id", "mark", "lo", mine.alias("m")).where(F.size("m") > 0)
        .groupBy("id", "mark").agg(F.flatten(F.collect_list(F.transform("m", lambda a: F.col("lo") + a))).alias("windows"))
    )
    schema = T.StructType([base.schema["row"]]).add("kept", "string").add("n_words", "long").add("n_removed", "long")
    out = base.join(gone, ["id", "mark"], "left").select("row", "windows").mapInArrow(_remove_fn(text_col, length), schema)
    own = ("kept", "n_words", "n_removed")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *own)


def _by_window(hot: DataFrame, length: int, shards: int, scratch: Scratch) -> DataFrame:
    """Located windows of anchors with very many different stretches: equal
    windows are one row, dealt by their hash."""
    spread = hot.mapInArrow(_window_fn(length), "anchor long, own long, a int, times long, id long, lo long, w1 long, w2 long, words binary")
    spread = scratch.keep(spread, "windows")
    alone = spread.groupBy("w1", "w2").agg(F.sum("times").alias("times"), F.min(F.struct("id", "lo")).alias("at"), F.min("words").alias("words")).where("times > 1")
    alone = alone.select(F.col("w1").alias("anchor"), F.col("w2").alias("own"), "times", F.lit(2).cast("long").alias("kinds"), "at.id", "at.lo", "words").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    alone = scratch.keep(alone, "alone", free=True)
    met = alone.groupBy("shard").applyInArrow(_shard_fn(length), "anchor long, own long, every array<int>, later array<int>")
    first = alone.select("anchor", "own", F.col("id").alias("id0"), F.col("lo").alias("lo0"))
    met = scratch.keep(met.join(first, ["anchor", "own"]).select(F.col("anchor").alias("w1"), F.col("own").alias("w2"), "id0", "lo0"), "met", free=True)
    back = spread.select("anchor", "own", "a", "id", "lo", "w1", "w2").join(met, ["w1", "w2"])
    later = F.when((F.col("id") != F.col("id0")) | (F.col("lo") != F.col("lo0")), F.col("a"))
    return back.groupBy("anchor", "own").agg(F.collect_list("a").alias("every"), F.collect_list(later).alias("later"))
