"""Set-similarity self join of documents by word n-grams (exact).

Universe-partition pigeonhole. Documents are cut into size bands; two linked
sets are in the same or in neighbouring bands. Each band hashes tokens into m
segments, m following from the largest symmetric difference H that a linked
pair of the band can have. If every segment i differed by more than its
allowance t_i (0: the segments are equal, 1: one deletion apart), the sets
would differ by sum(t_i + 1) > H; so a linked pair agrees on one signature.
A segment with allowance 0 is indexed by its subset hash, one with allowance 1
also by its one-deletion neighbourhood; a cost model (index entries plus
expected chance matches) allots the allowances per band. Empty segments are
left out: spare segments pay for as many as can be expected, t_i + 1 for an
empty segment of allowance t_i, and the few sets that have more than that
index their empty segments as well. (An empty segment costs its t_i + 1 if both
sets leave it out and 1 if one does and the other has a single token there, so
a pair loses no more than the mean of what its sets were spared.)

Candidates are verified exactly on the full sets. Groups never become all
their pairs: equal sets are one class first; a class is compared with the
smallest class it shares a signature with, its hub, and links are joined into
components. The buckets whose hubs are in one component form a group; in
groups that still hold several components the classes outside the largest one
meet the others through an inverted token index, and only links that join
components leave the task. A group over ``CHUNK_TOKENS`` is cut into parts, and
each two parts meet in a task of their own. Joins are shuffles that Spark can
split on a hot bucket or hub; tables in the shared folder cut lineage. Joins
of tables that grow with the corpus are merge joins at every size: none of
their sides has a bound to broadcast it by. Texts are compressed before they move.

Defined cases: a null or empty text, or one without words, has no shingles and
is linked with nothing; with fewer than k words the whole sequence is one
shingle; rows that repeat a doc_id are one document; a null doc_id is linked
with nothing and has no component; other columns are ignored. Shingles and
sets are compared as 64- and 128-bit hashes.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch
from .text import U64, as_signed, blocks, mix, shingle_sets

#: Cost of a chance match against an index entry (cost model of allowances).
MATCH_COST = 100.0
#: Tokens of one part of a group of candidates (a task holds two parts).
CHUNK_TOKENS = 2_000_000


class Bands:
    """Size bands and their signature schemes for J >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1, 2]

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            e = self.edges[-1]
            self.edges.append(max(e + 1, e * self.den // self.num))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def scheme(self, band: int) -> tuple[int, int, int]:
        return _scheme(self.num, self.den, self.edges[band], self.edges[band + 1] - 1)

    def bands_for(self, size: int) -> list[int]:
        """The band of a set, and the one below if a partner can be in it."""
        b = self.of(size)
        least = -(-self.num * size // self.den)
        return [b, b - 1] if b and least < self.edges[b] else [b]


@lru_cache(maxsize=4096)
def _scheme(num: int, den: int, low: int, top: int) -> tuple[int, int, int]:
    """(segments, of which with one deletion, units paid for empty ones)."""
    differ = (den - num) * (top + top * den // num) // (den + num)  # H
    size = (low + top) / 2
    best = None
    for ones in sorted({0, 1, 2, (differ + 1) // 4, (differ + 1) // 2}):
        m = differ + 1 - ones
        if m < max(1, ones):
            continue
        chance = math.exp(-size / m) if m > 1 else 0.0
        mean = (m + ones) * chance  # units of empty segments to be expected
        spare = 0 if mean < 1e-3 else math.ceil(mean + 3 * math.sqrt((m + 3 * ones) * chance))
        m += spare
        c = size / m
        chance = MATCH_COST * math.exp(-c)
        cost = (m - ones) * (1 + chance) + ones * (1 + 2 * c + (1 + 2 * c) * chance)
        if best is None or cost < best[0]:
            best = (cost, m, ones, spare)
    return best[1:]


def signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Signature hashes of one sorted token set."""
    out = []
    for band in bands.bands_for(len(tokens)):
        m, ones, spare = bands.scheme(band)
        t = mix(tokens ^ U64(band * 0x51ED270B + 0x2545F491))
        seg = ((t >> U64(32)) * U64(m)) >> U64(32)
        order = np.argsort(seg, kind="stable")
        seg, t = seg[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        total, where = np.add.reduceat(t, first), seg[first]
        salt = U64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out.append(mix(total ^ (where * U64(0xD1342543DE82EF95) + salt)))
        if ones:  # segments below ``ones``: every subset with one token less
            k = int(np.searchsorted(seg, ones))
            if k:
                lengths = np.diff(np.append(first, len(seg)))
                less = np.repeat(total, lengths)[:k] - t[:k]
                out.append(mix(less ^ (seg[:k] * U64(0xD1342543DE82EF95) + salt)))
        # an empty segment with one deletion counts twice
        if m - len(first) + ones - int(np.count_nonzero(where < ones)) > spare:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), where)
            out.append(mix(empty * U64(0xD1342543DE82EF95) + salt))
    return np.unique(np.concatenate(out))


def _describe_fn(k: int):
    def fn(batches):
        for batch in batches:
            sizes, h1, h2 = [], [], []
            for _, _, data, off in blocks(batch.column(1)):
                for s in shingle_sets(data, off, k):
                    sizes.append(len(s))
                    h1.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                    h2.append(int(np.add.reduce(mix(s ^ U64(0xA0761D6478BD642F))).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["doc_id", "n", "h1", "h2"],
            )

    return fn


def _signature_fn(k: int, num: int, den: int):
    def fn(batches):
        bands = Bands(num, den)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, off in blocks(batch.column(1), 1 << 18):
                found = [signatures(s, bands) if len(s) else s for s in shingle_sets(data, off, k)]
                if found:
                    doc = np.repeat(ids[i : i + len(found)], [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate(found))), pa.array(doc.astype(np.int64))], names=["sig", "doc_id"])

    return fn


def _text_fn(batches):
    """Texts as they travel to be compared: compressed, a third or less of
    their token sets' size."""
    for batch in batches:
        z = zstandard.ZstdCompressor(level=6)
        texts = [z.compress(t.as_buffer()) if t.is_valid else z.compress(b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["node", "body"])


def _tokens(body: pa.BinaryScalar, k: int) -> np.ndarray:
    """The token set of a compressed text."""
    raw = zstandard.ZstdDecompressor().decompress(body.as_buffer())
    return next(shingle_sets(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), k))


def _verify_fn(k: int, num: int, den: int):
    def fn(batches):
        for batch in batches:
            ok, last, p = [], None, None
            for x, y in zip(batch.column("x"), batch.column("y")):
                if last is None or not x.equals(last):  # the join brings a hub's pairs together
                    last, p = x, _tokens(x, k)
                q = _tokens(y, k)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return fn


def _join_group(nodes: list[int], component: list[int], tokens: list[np.ndarray], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components of one group: nodes outside the largest
    component meet every later node through an inverted token index. With two
    sides only pairs across count (the others meet elsewhere)."""
    n = len(nodes)
    sizes = np.array([len(t) for t in tokens])
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(n), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    comp, sides = np.array(component), np.array(side)
    two = len(np.unique(sides)) > 1
    names, counts = np.unique(comp, return_counts=True)
    largest = names[counts.argmax()]
    waiting = np.ones(n, dtype=bool)
    out = []
    for u in np.flatnonzero(comp != largest).tolist():
        waiting[u] = False
        a, b = np.searchsorted(flat, tokens[u], side="left"), np.searchsorted(flat, tokens[u], side="right")
        size = b - a
        hit = owner[np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)]
        common = np.bincount(hit, minlength=n)
        ok = waiting & (den * common >= num * (sizes + sizes[u] - common))
        if two:
            ok &= sides != sides[u]
        for v in np.flatnonzero(ok).tolist():
            p, q = find(component[u]), find(component[v])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((nodes[u], nodes[v]))
    return out


def _group_fn(k: int, num: int, den: int):
    def fn(table: pa.Table) -> pa.Table:
        out = []
        table = table.sort_by("hub")
        hubs = table["hub"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], hubs[1:] != hubs[:-1], [True])))
        reps, comps, side, body = table["rep"].to_pylist(), table["component"].to_pylist(), table["chunk"].to_pylist(), table["body"]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            tokens = [_tokens(v, k) for v in body.slice(a, b - a)]
            out.extend(_join_group(reps[a:b], comps[a:b], tokens, side[a:b], num, den))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return fn


def near_duplicates(
    spark: SparkSession, docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose shingle sets have a
    Jaccard similarity of ``num / den`` or more are linked; a component's id
    is its smallest doc_id."""
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    info = scratch.keep(src.mapInArrow(_describe_fn(k), "doc_id long, n long, h1 long, h2 long"), "sets")
    known = info.where("doc_id IS NOT NULL")
    # aggregated sides are written, so that Spark can split the joins on a hot key
    classes = scratch.keep(known.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps")
    member = scratch.keep(known.join(classes, ["h1", "h2"]).select("doc_id", "n", "rep").distinct(), "classes")

    sigs = src.where("doc_id IS NOT NULL").mapInArrow(_signature_fn(k, num, den), "sig long, doc_id long")
    # a bucket's hub is its smallest doc_id, which is its smallest class too
    shared = sigs.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("hi")).where("hub < hi").select("sig", "hub")
    shared = scratch.keep(shared, "shared", free=True)
    met = scratch.keep(sigs.join(shared.hint("merge"), "sig").select("hub", "doc_id").distinct(), "met", free=True)
    met = scratch.keep(met.join(member.hint("merge"), "doc_id").select("hub", "rep", "n").distinct(), "classes-met")

    nodes = met.select(F.col("rep").alias("node")).distinct()
    packed = src.where("doc_id IS NOT NULL").mapInArrow(_text_fn, "node long, body binary")  # before it moves
    texts = scratch.keep(packed.join(nodes.hint("merge"), "node"), "texts", free=True)

    # rows that repeat a doc_id with several texts are one document
    least = member.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = member.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))

    # first each class against the smallest hub it meets
    hub_size = met.where("rep = hub").select("hub", F.col("n").alias("hub_n")).distinct()
    pairs = (
        met.join(hub_size, "hub")
        .where((F.col("hub") != F.col("rep")) & (F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num))
        .groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a"))
    )
    x = texts.select(F.col("node").alias("a"), F.col("body").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("body").alias("y"))
    verified = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(_verify_fn(k, num, den), "a long, b long")
    links = scratch.keep(links.unionByName(verified), "verified", free=True)
    found = components(links, scratch)

    # buckets whose hubs are in one component form a group; groups that still
    # hold several components go on, in bounded parts
    of_hub = found.select(F.col("node").alias("hub"), F.col("component").alias("joined"))
    part = met.join(found, met["rep"] == found["node"], "left").select("hub", "rep", "n", F.coalesce("component", "rep").alias("component"))
    part = part.join(of_hub, "hub", "left").select(F.coalesce("joined", "hub").alias("hub"), "rep", "n", "component").distinct()
    part = scratch.keep(part, "groups")
    group = (
        part.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n").alias("tokens"))
        .where("lo < hi").select("hub", F.ceil(F.col("tokens") / F.lit(CHUNK_TOKENS)).cast("int").alias("chunks"), "tokens")
    )
    group = scratch.keep(group, "open")
    total = group.agg(F.sum("tokens")).first()[0]
    if total:
        lots = max(1, -(-int(total) // CHUNK_TOKENS))
        rows = part.join(group, "hub").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        one = F.col("chunks") == 1
        rows = rows.select(
            F.when(one, F.lit(None).cast("long")).otherwise(F.col("hub")).alias("big"),
            F.when(one, F.pmod(F.xxhash64("hub"), F.lit(lots))).otherwise(F.lit(-1)).alias("lot"),
            F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "hub", "rep", "component",
        )
        full = rows.join(texts.withColumnRenamed("node", "rep"), "rep")
        more = full.groupBy("big", "lot", "i", "j").applyInArrow(_group_fn(k, num, den), "a long, b long")
        more = scratch.keep(more, "more")
        found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    own = member.join(found, member["rep"] == found["node"], "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component")
    )
    own = own.groupBy("id").agg(F.min("component").alias("component"))
    sizes = info.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(own, sizes["doc_id"] == own["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
