"""Spelling variants: words of a corpus that differ by one edit, grouped under
the most frequent form.

``word_counts`` counts the words of all documents (counted per task first, so a
word that a third of all words are sends one row per task). ``variants`` finds
the near words of a vocabulary table (word, n) by Bloom-guided neighbourhoods:

1. The vocabulary is written into blocked Bloom filters, one per word length
   (``BITS`` bits a word, blocks of 64 bits, so a probe reads one number). The
   tasks build them; what reaches the driver and is broadcast is at most
   ``MAX_FILTER_BYTES`` at a time. A larger vocabulary takes more rounds, each
   with the filters of some lengths or, of a very frequent length, of some
   hash parts: the result is the same.
2. Each word's deletions and its replacements by a higher letter are generated
   as hashes (one rolling hash a word) and probed. That meets each pair of near
   words once: words that differ in length meet by the longer one's deletion.
   The letters tried are those the vocabulary holds.
3. Only positives become rows. An exact join with the vocabulary removes the
   false ones. An edit is the target of at most (length x letters) words, so no
   key of that join is hot.

``variants`` then takes each word's near words together, and the chains of
forms are followed by pointer doubling: a form is at least ``ratio`` times as
frequent as its word, so chains are short and have no cycles.

Defined cases: a null or empty text has no words; a null doc_id counts as an
empty one in the hash that drops letters; rows that repeat a doc_id count like
any other; words of any length take part (long ones are probed piece by
piece); among near words of equal n the smallest in code-point order is the
form; an empty table gives an empty result; only the two named columns are
read, so other columns cannot clash. Words with a null name or n are left out
by ``variants``, and rows that repeat a word count as one with the sum of n.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .text import U64, mix, release

MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
BITS = 24
MAX_FILTER_BYTES = 32 << 20
SEGMENT = 1 << 15  # blocks that one row of the build holds
LETTERS = "A-Za-zÀ-ÿ"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FLUSH = 200_000  # words counted before a task sends them on
_PIECE = 1 << 20  # characters of a text taken at once
_PROBES = 1 << 20  # edits probed at once
_BASE = 0x9E3779B97F4A7C15
_INV = U64(pow(_BASE, -1, 1 << 64))


# -- counting ----------------------------------------------------------------


def _pieces(text: str, edge: re.Pattern):
    """The text in pieces of bounded size, cut where no run is."""
    a = 0
    while len(text) - a > _PIECE:
        m = edge.search(text, a + _PIECE)
        b = m.start() if m else len(text)
        yield text[a:b]
        a = b
    yield text[a:]


def _count_fn(letters: str, min_chars: int, drop_every: int | None):
    def fn(batches):
        run, edge = re.compile(f"[{letters}]{{{min_chars},}}"), re.compile(f"[^{letters}]")
        seen: Counter = Counter()

        def rows():
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for ident, body in zip(batch.column("id").to_pylist(), batch.column("body")):
                text = body.as_buffer().to_pybytes().translate(_LOWER).decode("utf-8")
                start = zlib.crc32(b"%s:" % (b"" if ident is None else str(ident).encode()))
                for part in _pieces(text, edge):
                    found = Counter(run.findall(part))
                    if drop_every:
                        for word, n in found.items():
                            h = zlib.crc32(word.encode("utf-8"), start)
                            if h % drop_every == 0:
                                i = h % len(word)
                                word = word[:i] + word[i + 1 :]
                                if len(word) < min_chars:
                                    continue
                            seen[word] += n
                    else:
                        seen.update(found)
                    if len(seen) > _FLUSH:
                        yield rows()
        if seen:
            yield rows()
        release()

    return fn


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of ``letters`` (a character class), A-Z lower-cased, of
    at least ``min_chars`` code points and ``min_count`` occurrences. With
    ``drop_every`` a run whose crc32 of ``<doc_id>:<run>`` it divides loses the
    code point at (crc32 mod length) first: a typing error by rule."""
    base = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body")).where("body IS NOT NULL")
    parts = base.mapInArrow(_count_fn(letters, min_chars, drop_every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- hashes of words and of their edits ----------------------------------------


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a list of words."""
    off = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def _value(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + U64(0x632BE59BD9B4E019)) | U64(1)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _finish(total: np.ndarray, length) -> np.ndarray:
    return mix(total + np.asarray(length, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))


class _Words:
    """Rolling hashes of a batch of words: the sum of value(c) * base^place."""

    def __init__(self, words: list[str]):
        self.points, self.off = _flat(words)
        self.size = np.diff(self.off)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.points)) - self.off[self.word]
        self.power = _powers(int(self.size.max(initial=1)))[self.place]
        self.acc = np.zeros(len(self.points) + 1, dtype=np.uint64)
        self.value = _value(self.points)
        np.cumsum(self.value * self.power, out=self.acc[1:])
        self.total = self.acc[self.off[1:]] - self.acc[self.off[:-1]]

    def whole(self) -> np.ndarray:
        return _finish(self.total, self.size)

    def deletions(self, j: np.ndarray) -> np.ndarray:
        """Hashes of the words without the code point at flat index ``j``."""
        w = self.word[j]
        before = self.acc[j] - self.acc[self.off[w]]
        after = self.acc[self.off[w + 1]] - self.acc[j + 1]
        return _finish(before + after * _INV, self.size[w] - 1)

    def replacements(self, j: np.ndarray, value: np.ndarray) -> np.ndarray:
        w = self.word[j]
        return _finish(self.total[w] + (value - self.value[j]) * self.power[j], self.size[w])


# -- filters --------------------------------------------------------------------


class _Round:
    """The filters that are probed together: for each (length, part) its first
    block; ``shape`` maps a length to (parts, blocks of a part)."""

    def __init__(self, shape: dict, shards: list):
        self.first, self.blocks = {}, 0
        for length, part in shards:
            self.first[length, part] = self.blocks
            self.blocks += shape[length][1]
        self.shape = {length: shape[length] for length, _ in shards}

    def place(self, h: np.ndarray, length: int) -> np.ndarray:
        """Block of each hash of one length; -1: not in this round."""
        if length not in self.shape:
            return np.full(len(h), -1, dtype=np.int64)
        parts, blocks = self.shape[length]
        first = np.array([self.first.get((length, p), -1) for p in range(parts)], dtype=np.int64)
        at = first[(h % U64(parts)).astype(np.int64)] if parts > 1 else np.full(len(h), first[0])
        inside = ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)
        return np.where(at < 0, -1, at + inside)


def _mask(h: np.ndarray) -> np.ndarray:
    """Five bits of a block."""
    x = mix(h ^ U64(0x5851F42D4C957F2D))
    out = np.zeros(len(h), dtype=np.uint64)
    for s in range(0, 30, 6):
        out |= U64(1) << ((x >> U64(s)) & U64(63))
    return out


def rounds(sizes: dict[int, int], max_bytes: int = MAX_FILTER_BYTES) -> list[_Round]:
    """Filters for ``sizes`` (words per length) in rounds of at most
    ``max_bytes``; a length whose filter is larger goes by hash parts."""
    most = max_bytes // 8
    shape = {}
    for length, n in sizes.items():
        blocks = max(1, -(-n * BITS // 64))
        parts = -(-blocks // most)
        shape[length] = (parts, -(-blocks // parts))
    out, shards, used = [], [], 0
    for length in sorted(shape):
        parts, blocks = shape[length]
        for p in range(parts):
            if shards and used + blocks > most:
                out.append(_Round(shape, shards))
                shards, used = [], 0
            shards.append((length, p))
            used += blocks
    if shards:
        out.append(_Round(shape, shards))
    return out


def _set_fn(rnd: _Round):
    def fn(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            w = _Words(words)
            h = w.whole()
            at = np.full(len(words), -1, dtype=np.int64)
            for length in np.unique(w.size):
                mine = np.flatnonzero(w.size == length)
                at[mine] = rnd.place(h[mine], int(length))
            hit = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[hit] // SEGMENT), pa.array(at[hit] % SEGMENT), pa.array(_mask(h[hit]).view(np.int64))], names=["segment", "block", "mask"])

    return fn


def _segment_fn(key, table):
    seg = np.zeros(SEGMENT, dtype=np.uint64)
    np.bitwise_or.at(seg, table.column("block").to_numpy(), table.column("mask").to_numpy().view(np.uint64))
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([seg.tobytes()], pa.binary())})


def _filter(vocabulary: DataFrame, rnd: _Round) -> np.ndarray:
    """The round's filters as one array of blocks, built in the tasks."""
    marks = vocabulary.select("word").mapInArrow(_set_fn(rnd), "segment long, block long, mask long")
    bits = np.zeros(-(-rnd.blocks // SEGMENT) * SEGMENT, dtype=np.uint64)
    for r in marks.groupBy("segment").applyInArrow(_segment_fn, "segment long, bits binary").collect():  # at most MAX_FILTER_BYTES
        bits[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["bits"], dtype=np.uint64)
    return bits


def _probe_fn(rnd: _Round, bits, letters: np.ndarray):
    """(word, n, edit) of every edit that the round's filters hold."""

    def fn(batches):
        table = bits.value
        value = _value(letters)

        def positive(h, lengths):
            out = np.zeros(len(h), dtype=bool)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                at = rnd.place(h[mine], int(length))
                ok = at >= 0
                m = _mask(h[mine[ok]])
                out[mine[ok]] = (table[at[ok]] & m) == m
            return out

        for batch in batches:
            names, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            keep = [i for i, x in enumerate(names) if len(x) in rnd.shape or len(x) - 1 in rnd.shape]
            if not keep:
                continue
            names, counts = [names[i] for i in keep], [counts[i] for i in keep]
            w = _Words(names)
            source, edits = [], []
            step = max(1, _PROBES // max(1, len(letters)))
            for a in range(0, len(w.points), step):
                j = np.arange(a, min(len(w.points), a + step))
                # equal neighbours: one deletion stands for all of the run
                d = j[(w.place[j] == 0) | (w.points[j] != w.points[j - 1])]
                d = d[positive(w.deletions(d), w.size[w.word[d]] - 1)]
                for i in d.tolist():
                    name, p = names[w.word[i]], int(w.place[i])
                    source.append(int(w.word[i]))
                    edits.append(name[:p] + name[p + 1 :])
                row, letter = np.nonzero(letters[None, :] > w.points[j][:, None])
                row = j[row]
                hit = positive(w.replacements(row, value[letter]), w.size[w.word[row]])
                for i, x in zip(row[hit].tolist(), letters[letter[hit]].tolist()):
                    name, p = names[w.word[i]], int(w.place[i])
                    source.append(int(w.word[i]))
                    edits.append(name[:p] + chr(x) + name[p + 1 :])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in source], pa.string()), pa.array([counts[i] for i in source], pa.int64()), pa.array(edits, pa.string())],
                names=["word", "n", "edit"],
            )

    return fn


# -- the operator ---------------------------------------------------------------


def near_words(vocabulary: DataFrame, scratch: Scratch, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Each pair of words of a written table (word, n) at one edit, once:
    (word, n, edit, edit_n)."""
    spark = vocabulary.sparkSession
    sizes = {int(r["size"]): int(r["count"]) for r in vocabulary.groupBy(F.char_length("word").alias("size")).count().collect()}
    # the letters in use: as many as the character class of the words has
    points = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    letters = np.array(sorted(ord(r["c"]) for r in points.collect()), dtype=np.uint32)
    found = None
    for k, rnd in enumerate(rounds(sizes, max_bytes)):
        bits = spark.sparkContext.broadcast(_filter(vocabulary, rnd))
        hits = scratch.keep(vocabulary.mapInArrow(_probe_fn(rnd, bits, letters), "word string, n long, edit string"), f"positives-{k}")
        bits.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return vocabulary.select("word", "n", F.lit("").alias("edit"), F.lit(0).cast("long").alias("edit_n")).limit(0)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    return scratch.keep(found.join(known, "edit").select("word", "n", "edit", "edit_n"), "near", free=True)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) by pointer doubling over (word, form)."""
    at = scratch.keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.keep(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "pointers")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(spark: SparkSession, words: DataFrame, ratio: float = RATIO, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``words`` (word, n) with ``n_near`` (words at one edit), ``form`` (the
    most frequent of them, if its n is at least ``ratio`` times the word's),
    ``form_n`` and ``root`` (the last of the forms; the word itself if none)."""
    scratch = Scratch(spark, "spelling")
    words = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocabulary = scratch.keep(words, "vocabulary", free=True)
    pairs = near_words(vocabulary, scratch, max_bytes)
    back = pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(back)
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = vocabulary.join(near, "word", "left")
    better = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    known = scratch.keep(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n"),
        ),
        "known", free=True,
    )
    last = roots(known.where("form IS NOT NULL"), scratch)
    out = known.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
