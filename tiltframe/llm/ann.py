"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree gives every vector a long hash string (``BITS`` signs of random
projections; vectors get one more coordinate that makes all lengths equal, so
that the largest inner product is the smallest angle). A tree is the sorted
array of these strings. A query descends each tree to its longest common
prefix and then ascends all trees in step, one bit at a time, until the
prefixes of that length hold the candidates asked for together; these are scored
exactly on the original vectors.

Vectors of one length and of norms within a factor of 2 (a zone) have a forest
of their own, with the added coordinate, the candidates and the block sizes
that follow from its vectors: one long vector does not push the others into
one prefix. A query searches every zone of its vector length.

The sorted arrays lie in blocks by prefix, short enough that the blocks of a
query usually hold its candidates; a crowded prefix is followed further down,
and one with more than 8 x ``BLOCK_ROWS`` entries is dealt over several blocks
that queries visit alike. The first pass brings back how many entries share
each prefix length: from the query's own block in each tree, and above that
block's length from the sizes of the blocks below each prefix. The second
scores the candidates; where the ascent ends above a query's block (or the
query has none) it visits all blocks below the prefix, up to the root, which
one tree holds whole. Every row is indexed, no bucket is cut. Equal vectors
are one point with its k + 1 smallest ids. Zones of every size take this one
way; where all trees together hold fewer entries than the candidates asked for,
the ascent ends at the root, and the search is exact.

The queries that visit a block are dealt into batches of ``BATCH_QUERIES`` at
most on average, each with a copy of the block: a prefix that most queries
share stays in no single task, and a task holds one block and one batch.

Defined cases: vectors that are null, zero or hold null, NaN or infinite
components take no part; only vectors of equal length are compared; a null id
takes no part; rows with the same id are the same item; fewer than k
candidates are all returned; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .vectors import matrix, points, ranked

TREES = 32
BITS = 64
BLOCK_ROWS = 2048
BATCH_QUERIES = 4096
#: Entries gathered per query over all trees (a vector found in two trees is two):
#: a share of a zone's vectors, and at least so many. The share sets the recall:
#: vectors without any structure need this one for 0.9 and more at 20 neighbours;
#: clustered ones do with a hundredth.
SHARE = 0.6
CANDIDATES = 2000
SEED = 7


def _planes(d: int, tree: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d, tree]).standard_normal((d + 1, BITS))


def _hash_fn(forests: dict[tuple[int, int], tuple[int, float]], seed: int, query: bool):
    """One row per vector and tree: the bit string as a number. ``forests``:
    trees and largest norm of each (length, zone); a query's string is the
    same in all zones, so that its rows name none."""
    weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)

    def fn(batches):
        most = {}
        for (d, _), (trees, _) in forests.items():
            most[d] = max(most.get(d, 0), trees)
        planes = {d: [_planes(d, t, seed) for t in range(n)] for d, n in most.items()}
        for batch in batches:
            names = batch.schema.names
            size, zone = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("d", "zone"))
            if query:
                zone = np.zeros_like(zone)
            for d, z in np.unique(np.column_stack((size, zone)), axis=0).tolist():
                mine = np.flatnonzero((size == d) & (zone == z))
                x = matrix(batch.column(names.index("v")).take(pa.array(mine)))
                if query:
                    trees, rest = most[d], np.zeros(len(x))
                else:
                    trees, longest = forests[d, z]
                    x = x / longest
                    rest = np.sqrt(np.maximum(1.0 - (x**2).sum(axis=1), 0.0))
                x = np.column_stack((x, rest))
                uid = batch.column(names.index("uid")).take(pa.array(mine))
                for t in range(trees):
                    h = ((x @ planes[d][t] > 0) * weight).sum(axis=1, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [uid, *(pa.array(np.full(len(mine), c, np.int32)) for c in (d, z, t)), pa.array(h.view(np.int64))],
                        names=["uid", "d", "zone", "tree", "h"],
                    )

    return fn


def prefix_range(q: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest string that agree with ``q`` on ``bits`` bits."""
    rest = np.uint64((1 << (BITS - bits)) - 1)
    return q & ~rest, q | rest


def _profile_fn():
    """How many entries of a block share at least each prefix length with a
    query (from the block's own length to BITS): two binary searches in the
    sorted array each."""

    def fn(index: pa.Table, asked: pa.Table) -> pa.Table:
        h = np.sort(index["h"].to_numpy().view(np.uint64))
        uid, q = asked["uid"].to_numpy(), asked["h"].to_numpy().view(np.uint64)
        out = np.zeros((len(q), BITS + 1), dtype=np.int64)
        for bits in range(index["bits"][0].as_py(), BITS + 1):
            low, high = prefix_range(q, bits)
            out[:, bits] = np.searchsorted(h, high, side="right") - np.searchsorted(h, low, side="left")
        zone = pa.array(np.full(len(q), index["zone"][0].as_py(), np.int32))
        return pa.table({"uid": uid, "zone": zone, "shared": pa.array(list(out), pa.list_(pa.int64()))})

    return fn


def _score_fn(k: int):
    def fn(index: pa.Table, asked: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not index.num_rows or not asked.num_rows:
            return pa.table(empty)
        h = index["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, x, uid, low_id = h[order], matrix(index["v"])[order], index["uid"].to_numpy()[order], index["low"].to_numpy()[order]
        q, q_uid, q_h, level = matrix(asked["v"]), asked["uid"].to_numpy(), asked["h"].to_numpy().view(np.uint64), asked["level"].to_numpy()
        # how far a product may be from the plain loop's, in norms of the query
        off = (x.shape[1] + 4) * 2.0**-51 * float(np.sqrt((x**2).sum(axis=1)).max())
        out: list[list[np.ndarray]] = [[], [], []]
        first, end = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        for bits in np.unique(level).tolist():
            mine = level == bits
            low, high = prefix_range(q_h[mine], int(bits))
            first[mine], end[mine] = np.searchsorted(h, low, side="left"), np.searchsorted(h, high, side="right")
        for i in range(len(q)):
            a, b = int(first[i]), int(end[i])
            if a == b:
                continue
            near = x[a:b] @ q[i]
            most = min(len(near), k)
            least = np.partition(near, -most)[-most] - off * float(np.sqrt(q[i] @ q[i]))
            top = a + np.flatnonzero(~(near < least))
            score = np.zeros(len(top))  # component after component, as a plain loop adds
            for j in range(q.shape[1]):
                score += x[top, j] * q[i, j]
            best = np.lexsort((low_id[top], -score))[:most]
            for c, v in zip(out, (np.full(most, q_uid[i]), uid[top[best]], score[best])):
                c.append(v)
        if not out[0]:
            return pa.table(empty)
        return pa.table({n: np.concatenate(c) for n, c in zip(("q", "p", "score"), out)})

    return fn


def nearest(
    spark: SparkSession, vectors: DataFrame, queries, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = TREES, share: float = SHARE, candidates: int = CANDIDATES, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` near vectors by inner product
    for every id that ``queries`` accepts."""
    scratch = Scratch(spark, "ann")
    pts, holders = points(vectors, scratch, k + 1, id_col, vec_col, lambda c: c, lambda v: F.exists(v, lambda c: c != 0))
    # by the largest component first: squares of doubles can leave their range
    big = F.array_max(F.transform("v", F.abs))
    norm = F.col("big") * F.sqrt(F.aggregate(F.transform("v", lambda c: c / F.col("big")), F.lit(0.0), lambda a, c: a + c * c))
    pts = pts.withColumn("big", big).withColumn("norm", norm).withColumn("zone", F.floor(F.log2("norm") + 0.5).cast("int")).drop("big")
    stats = pts.groupBy("d", "zone").agg(F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect()  # one row per vector length and power of 2
    forests, plan = {}, []
    for r in stats:
        n, want = r["n"], max(candidates, math.ceil(share * r["n"]))
        # blocks no smaller than the ascent usually needs: together they hold
        # 1.5 times the candidates
        depth = max(0, math.floor(math.log2(trees * n / (1.5 * want))))
        forests[r["d"], r["zone"]] = (trees, r["m"])
        plan.append((r["d"], r["zone"], trees, depth, want, max(BLOCK_ROWS, n >> depth)))
    plan = F.broadcast(spark.createDataFrame(plan, "d int, zone int, trees int, depth int, want long, usual long"))
    entry = "uid long, d int, zone int, tree int, h long"
    index = scratch.keep(pts.select("uid", "d", "zone", "v").mapInArrow(_hash_fn(forests, seed, False), entry), "index")
    asked = pts.join(holders.where(queries(F.col("id"))).select("uid").distinct(), "uid", "left_semi")
    asked = scratch.keep(asked.select("uid", "d", "zone", "v").mapInArrow(_hash_fn(forests, seed, True), entry), "asked")
    asked = asked.drop("zone").join(plan.select("d", "zone", "trees"), "d").where("tree < trees").select("uid", "d", "zone", "tree", "h")

    def prefix(bits):
        """The leading ``bits`` (a column) of the string, as a number."""
        return F.when(F.col(bits) <= 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(h, cast({BITS} - {bits} as int))"))

    first = index.join(plan, ["d", "zone"]).withColumn("top", prefix("depth"))
    first = first.groupBy("d", "zone", "tree", "top", "depth", "usual").agg(F.count(F.lit(1)).alias("n"))
    # a crowded prefix is followed further down, by as many bits as its crowd
    # needs; what still shares one string is dealt over several blocks
    more = first.where((F.col("depth") > 0) & (F.col("n") > 4 * F.col("usual")))
    deep = F.least(F.lit(BITS), F.col("depth") + F.ceil(F.log2(F.col("n") / F.col("usual")))).cast("int")
    more = scratch.keep(more.select("d", "zone", "tree", "top", deep.alias("deep")), "crowded")

    def placed(df):
        j = df.join(plan.select("d", "zone", "depth"), ["d", "zone"]).withColumn("top", prefix("depth")).join(more, ["d", "zone", "tree", "top"], "left")
        j = j.withColumn("bits", F.coalesce("deep", "depth")).withColumn("pre", prefix("bits"))
        return j.select("uid", "h", *place)

    place = ["d", "zone", "tree", "bits", "pre"]
    key = [*place, "part"]
    index, own = placed(index), scratch.keep(placed(asked), "own")
    parts = F.ceil(F.col("n") / F.lit(8 * BLOCK_ROWS)).cast("int")
    sizes = scratch.keep(index.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts), "blocks")
    index = index.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).select("uid", "h", *key)
    index = scratch.keep(index, "entries")
    # the blocks below each shorter prefix; one tree holds all of the root's
    above = sizes.withColumn("least", F.when(F.col("tree") == 0, 0).otherwise(1)).where("least < bits")
    above = above.withColumn("up", F.explode(F.sequence("least", F.col("bits") - 1)))
    above = above.withColumn("top", F.when(F.col("up") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(pre, bits - up)")))
    above = scratch.keep(above.select("d", "zone", "tree", "up", "top", "bits", "pre", "parts", "n"), "above")
    shorter = ["d", "zone", "tree", "up", "top"]

    def in_parts(df):
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def dealt(visits, name):
        """Blocks and their visits, both by batch of queries; the counts are a
        table of their own, so that Spark can split a block's visits."""
        visits = scratch.keep(visits, name)
        load = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(BATCH_QUERIES)).cast("int").alias("batches"))
        load = scratch.keep(load, name + "-load")
        blocks = index.join(load, key).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")
        return blocks, visits.join(load, key).withColumn("batch", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("batches")).cast("int")).drop("batches")

    blocks, visits = dealt(in_parts(own.join(sizes, place)).select("uid", "h", *key), "visits")
    counts = blocks.groupBy(*key, "batch").cogroup(visits.groupBy(*key, "batch")).applyInArrow(_profile_fn(), "uid long, zone int, shared array<bigint>")
    counts = counts.select("uid", "zone", F.posexplode("shared").alias("bits", "n")).where("n > 0")
    rising = own.where("bits > 1").withColumn("up", F.explode(F.sequence(F.lit(1), F.col("bits") - 1))).withColumn("top", prefix("up"))
    rising = rising.drop("bits", "pre").join(above.groupBy(*shorter).agg(F.sum("n").alias("n")), shorter)
    counts = counts.unionByName(rising.select("uid", "zone", F.col("up").alias("bits"), "n"))
    level = counts.groupBy("uid", "zone", "bits").agg(F.sum("n").alias("n")).join(own.select("uid", "d").distinct(), "uid")
    level = level.join(plan.select("d", "zone", "want"), ["d", "zone"]).where("n >= want").groupBy("uid", "zone").agg(F.max("bits").alias("level"))
    own = own.join(level, ["uid", "zone"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    own = scratch.keep(own.where("level > 0 OR tree = 0"), "levels")

    stay = own.where("bits <= level").join(sizes, place)
    rise = own.where("bits > level").withColumn("up", F.col("level")).withColumn("top", prefix("up")).drop("bits", "pre").join(above, shorter)
    visits = in_parts(stay.select("uid", "h", "level", *place, "parts").unionByName(rise.select("uid", "h", "level", *place, "parts")))
    blocks, visits = dealt(visits.select("uid", "h", "level", *key), "rounds")
    vec = pts.select("uid", "v")
    left = blocks.join(pts.select("uid", "v", "low"), "uid")
    right = visits.join(vec, "uid").select(*(F.col(c).alias(c) for c in (*key, "batch", "uid", "h", "level", "v")))
    found = left.groupBy(*key, "batch").cogroup(right.groupBy(*key, "batch")).applyInArrow(_score_fn(k + 1), "q long, p long, score double")
    return ranked(found.distinct(), holders, pts, queries, k)
