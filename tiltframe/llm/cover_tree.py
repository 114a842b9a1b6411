"""Exact top-k inner products by dual-tree search on cover trees.

Queries and data are indexed together: a bounded set of far-apart centers
(``CENTERS``) is the top of the tree, every point goes to its nearest center,
and each cell is dealt into blocks of about ``BLOCK_ROWS`` points, each with a
cover tree of its own (children lie within half the radius of their node, the
centers of children are farther apart than that). For a query node with center
a and radius r and a data node with center b and radius s no pair scores more
than a.b + |a| s + |b| r + r s; if that is below the worst kth score of the
query node's queries, the pair of nodes is pruned, first for pairs of cells,
then for pairs of tree nodes inside a task. Equal scores are never pruned.

The first round looks only at the query cell's most promising blocks and
yields the kth scores that prune the second. A query batch holds at most
``BATCH_QUERIES`` queries and a task one block and one batch, whatever the
input; equal vectors are one point that keeps its k + 1 smallest ids, so a
vector that a third of all rows hold costs no more than one.

Scores are exact at every size: doubles bound and prune, and where the norms
of a pair allow sums of 2^53 or more, the pairs that can still count are summed
in integers.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part; an error if a score of the answer does not fit a long or a scaled
component does not fit a double; only vectors of equal length are compared; a
null id takes no part; rows with the same id are the same item and are no
candidates for each other; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .vectors import matrix, points, ranked

CENTERS = 48
SAMPLE = 2000  # points the centers are chosen from
BLOCK_ROWS = 2048
BATCH_QUERIES = 4096
LEAF = 192  # rows of a leaf: pairs of leaves are matrix products
_EXACT = float(1 << 53)  # doubles below hold every integer
_HUGE = 2.0**256  # components whose squares may leave a double: never pruned
#: Scores are clipped to this size, which no score of the answer may have.
_MOST = (1 << 63) - 1


class Node:
    __slots__ = ("center", "norm", "radius", "kids", "rows")

    def __init__(self, center, radius, rows, kids):
        self.center, self.norm = center, float(np.sqrt(center @ center))
        self.radius, self.rows, self.kids = radius, rows, kids


def _huge(x: np.ndarray) -> np.ndarray:
    return (np.abs(x) >= _HUGE).any(axis=1)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, at: int | None = None) -> Node:
    """Cover tree over the rows of ``x``."""
    if rows is None:
        rows, at = np.arange(len(x)), 0
        huge = _huge(x)
        if huge.any():
            apart = np.array_split(rows[huge], -(-int(huge.sum()) // LEAF))
            nodes = [Node(np.zeros(x.shape[1]), np.inf, r, []) for r in apart]
            if not huge.all():
                nodes.append(cover_tree(x, rows[~huge], int(rows[~huge][0])))
            return Node(np.zeros(x.shape[1]), np.inf, rows, nodes)
    dist = np.sqrt(((x[rows] - x[at]) ** 2).sum(axis=1))
    radius = float(dist.max())
    if len(rows) <= LEAF or radius == 0.0:
        return Node(x[at], radius, rows, [])
    kids, left, center = [], rows, at
    while len(left):
        near = np.sqrt(((x[left] - x[center]) ** 2).sum(axis=1)) <= radius / 2
        kids.append((left[near], center))
        left = left[~near]
        if len(left):
            center = int(left[0])
    lone = [k for k in kids if len(k[0]) < LEAF // 4]  # stragglers share leaves
    nodes = [cover_tree(x, r, c) for r, c in kids if len(r) >= LEAF // 4]
    if lone:
        rest = np.concatenate([r for r, _ in lone])
        for part in np.array_split(rest, -(-len(rest) // LEAF)):
            c = x[part].mean(axis=0)
            nodes.append(Node(c, float(np.sqrt(((x[part] - c) ** 2).sum(axis=1)).max()), part, []))
    return Node(x[at], radius, rows, nodes)


def _below(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above the integer scores."""
    f = score.astype(np.float64)
    return np.where(np.abs(f) < _EXACT, f, f - np.abs(f) * 2.0**-52)


def _sum(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of doubles that hold integers."""
    s = sum(int(u) * int(v) for u, v in zip(a.tolist(), b.tolist()) if u and v)
    return max(-_MOST, min(_MOST, s))


class _Best:
    """The k best data rows of each query, by score and then smallest id.
    ``worst``: a bound not above the kth score."""

    def __init__(self, k: int, worst: np.ndarray):
        n = len(worst)
        self.k, self.worst = k, worst.copy()
        self.score, self.low = np.full((n, k), -_MOST), np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1, dtype=np.int64)

    def _keep(self, j: int, rows: np.ndarray, low: np.ndarray, score: np.ndarray) -> None:
        s = np.concatenate((self.score[j], score))
        lo = np.concatenate((self.low[j], low))
        r = np.concatenate((self.row[j], rows))
        top = np.lexsort((lo, -s))[: self.k]
        self.score[j], self.low[j], self.row[j] = s[top], lo[top], r[top]
        if self.row[j, -1] >= 0:
            self.worst[j] = max(self.worst[j], _below(self.score[j, -1:])[0])

    def add(self, q: np.ndarray, rows: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Data rows ``rows`` (vectors ``b``) for queries ``q`` (vectors ``a``)."""
        with np.errstate(over="ignore", invalid="ignore"):
            score = a @ b.T
            p, r = (np.sqrt((v * v).sum(axis=1)) for v in (a, b))
            if p.max() * r.max() < _EXACT / 2:  # every sum is exact
                for i in np.flatnonzero((score >= self.worst[q, None]).any(axis=1)).tolist():
                    self._keep(q[i], rows, low, np.rint(score[i]).astype(np.int64))
                return
            off = p[:, None] * r * ((a.shape[1] + 4) * 2.0**-52)  # what rounding may take or give
            hits = ~(score + off < self.worst[q, None])
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                hit = hits[i]
                least = np.nan_to_num(score[i] - off[i], nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
                if len(least) > self.k:  # k rows are at least as good as the kth of these
                    hit = hit & ~(score[i] + off[i] < np.partition(least, -self.k)[-self.k])
                at = np.flatnonzero(hit)
                exact = np.array([_sum(a[i], b[j]) for j in at.tolist()], dtype=np.int64)
                self._keep(q[i], rows[at], low[at], exact)


def _bound(product: float, a: float, r: float, b: float, s: float) -> float:
    """No pair scores more, rounding included: centers of norms ``a`` and ``b``
    and their inner product, radii ``r`` and ``s``."""
    return product + a * s + b * r + r * s + 1e-9 * (a + r) * (b + s) + 1e-6


def dual_search(q: np.ndarray, x: np.ndarray, low: np.ndarray, k: int, worst: np.ndarray) -> _Best:
    """Best ``k`` rows of ``x`` for each row of ``q`` that can still beat or
    tie the query's ``worst`` score."""
    best = _Best(k, worst)
    todo = [(cover_tree(q), cover_tree(x))]
    while todo:
        a, b = todo.pop()
        with np.errstate(invalid="ignore"):  # not a number: not pruned
            most = _bound(a.center @ b.center, a.norm, a.radius, b.norm, b.radius)
        if most < best.worst[a.rows].min():
            continue
        if not a.kids and not b.kids:
            best.add(a.rows, b.rows, low[b.rows], q[a.rows], x[b.rows])
        elif not b.kids or (a.kids and a.radius > b.radius):
            todo.extend((c, b) for c in a.kids)
        else:
            # the most promising child comes off the stack first
            todo.extend((a, c) for c in sorted(b.kids, key=lambda c: a.center @ c.center))
    return best


def _centers(sample: np.ndarray, most: int) -> np.ndarray:
    """Far-apart points of a sample: each next one is farthest from the rest."""
    sample = sample[~_huge(sample)] if not _huge(sample).all() else np.zeros((1, sample.shape[1]))
    chosen = [0]
    dist = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _cell_fn(centers: dict[int, np.ndarray]):
    def fn(batches):
        for batch in batches:
            d = batch.column(batch.schema.get_field_index("d")).to_numpy(zero_copy_only=False)
            v = batch.column(batch.schema.get_field_index("v"))
            cell, dist = np.zeros(len(d), dtype=np.int32), np.zeros(len(d))
            for size in np.unique(d).tolist():
                mine = np.flatnonzero(d == size)
                x, c = matrix(v.take(pa.array(mine))), centers[size]
                if size:
                    huge = _huge(x)
                    near = np.where(huge[:, None], 0.0, x)
                    d2 = (near**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * near @ c.T
                    cell[mine] = d2.argmin(axis=1)
                    dist[mine] = np.where(huge, np.inf, np.sqrt(((near - c[cell[mine]]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names=[*batch.schema.names, "cell", "dist"])

    return fn


def _search_fn(k: int):
    def fn(data: pa.Table, asked: pa.Table) -> pa.Table:
        x, low, uid = matrix(data["v"]), data["low"].to_numpy(), data["uid"].to_numpy()
        q, q_uid = matrix(asked["v"]), asked["uid"].to_numpy()
        if not len(x) or not len(q):
            return pa.table({"q": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        best = dual_search(q, x, low, k + 1, asked["worst"].to_numpy().astype(np.float64))
        i, j = np.nonzero(best.row >= 0)
        return pa.table({"q": q_uid[i], "p": uid[best.row[i, j]], "score": best.score[i, j]})

    return fn


def top_k(spark: SparkSession, vectors: DataFrame, queries, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of
    floor(``scale`` * x) vectors for every id that ``queries`` accepts."""
    scratch = Scratch(spark, "cover-tree")

    def scaled(c):
        y = c * scale  # doubles of 2^53 and more are integers, and may not fit a long
        whole = F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y)
        return whole.otherwise(F.raise_error(F.lit("a scaled component does not fit a double")).cast("double"))

    pts, holders = points(vectors, scratch, k + 1, id_col, vec_col, scaled)
    sample = pts.select("d", "v", F.xxhash64("uid").alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("h"))).where(F.col("r") <= SAMPLE)
    by_size: dict[int, list] = {}
    for r in sample.orderBy("d", "h").collect():  # bounded: SAMPLE points of each vector length
        by_size.setdefault(r["d"], []).append(r["v"])
    centers = {d: _centers(np.array(v, dtype=np.float64).reshape(len(v), -1), CENTERS) for d, v in by_size.items()}
    cells = scratch.keep(
        pts.mapInArrow(_cell_fn(centers), "uid long, v array<double>, d int, ids array<long>, low long, cell int, dist double"), "cells"
    )
    asked = holders.where(queries(F.col("id"))).select("uid").distinct()
    asked = cells.join(asked, "uid", "left_semi")
    stats = {(r["d"], r["cell"]): (r["n"], r["radius"]) for r in cells.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    reach = {(r["d"], r["cell"]): (r["n"], r["radius"]) for r in asked.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    subs = {c: max(1, -(-n // BLOCK_ROWS)) for c, (n, _) in stats.items()}
    batches = max(1, -(-sum(n for n, _ in reach.values()) // BATCH_QUERIES))

    def bound(qc, pc):
        a, b = centers[qc[0]][qc[1]], centers[pc[0]][pc[1]]
        r, s = reach[qc][1], stats[pc][1]
        if math.isinf(r) or math.isinf(s):
            return math.inf
        na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
        return float(_bound(a @ b, na, r, nb, s))

    cell_table = spark.createDataFrame([(d, c, n) for (d, c), n in subs.items()], "d int, cell int, subs int")
    data = cells.join(F.broadcast(cell_table), ["d", "cell"]).select(
        "d", F.col("cell").alias("p_cell"), F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int").alias("sub"), "uid", "v", "low"
    )
    asked = asked.select(
        "d", F.col("cell").alias("q_cell"), F.pmod(F.xxhash64(F.lit("batch"), "uid"), F.lit(batches)).cast("int").alias("batch"), "uid", "v"
    )

    def search(pairs: list[tuple[int, int, int, int, int]], queries_: DataFrame) -> DataFrame:
        """Blocks against batches for (d, query cell, data cell, first block,
        end block): at most one row per pair of cells, blocks and batches are
        told apart in Spark."""
        if not pairs:
            return spark.createDataFrame([], "q long, p long, score long")
        table = F.broadcast(spark.createDataFrame(pairs, "d int, q_cell int, p_cell int, lo int, hi int"))
        right = queries_.join(table, ["d", "q_cell"]).withColumn("sub", F.explode(F.sequence("lo", F.col("hi") - 1)))
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        for d, _, c, lo, hi in pairs:
            have = spans.get((d, c), (lo, hi))
            spans[(d, c)] = (min(have[0], lo), max(have[1], hi))
        used = F.broadcast(spark.createDataFrame([(*c, *v) for c, v in spans.items()], "d int, p_cell int, lo int, hi int"))
        left = data.join(used, ["d", "p_cell"]).where((F.col("sub") >= F.col("lo")) & (F.col("sub") < F.col("hi")))
        left = left.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        # a block's tree is built once for all queries of a batch
        key = ["d", "batch", "p_cell", "sub"]
        left = left.select(*key, "uid", "v", "low")
        right = right.select(*(F.col(c).alias(c) for c in (*key, "uid", "v", "worst")))  # names of its own: both sides come from one table
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search_fn(k), "q long, p long, score long")

    first = []
    for q in reach:
        near = sorted((p for p in stats if p[0] == q[0]), key=lambda p: -float(centers[q[0]][q[1]] @ centers[p[0]][p[1]]))[:2]
        first += [(q[0], q[1], p[1], 0, 1) for p in near]
    start = asked.withColumn("worst", F.lit(float("-inf")))
    found = scratch.keep(search(first, start), "first")
    # the kth best of k + 1 points so far: no later point below it is needed
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    # (a double rounded down)
    down = F.col("score").cast("double")
    down = F.when(F.abs(down) < _EXACT, down).otherwise(down - F.abs(down) * 2.0**-52)
    kth = found.withColumn("r", F.row_number().over(w)).where(F.col("r") == k + 1).select(F.col("q").alias("uid"), down.alias("kth"))
    second = asked.join(kth, "uid", "left").select("d", "q_cell", "batch", "uid", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("worst"))
    second = scratch.keep(second, "asked")
    least = {(r["d"], r["q_cell"]): r["w"] for r in second.groupBy("d", "q_cell").agg(F.min("worst").alias("w")).collect()}
    seen = {f[:3] for f in first}
    rest = [
        (q[0], q[1], p[1], int((q[0], q[1], p[1]) in seen), subs[p])
        for q in reach for p in stats if p[0] == q[0] and not bound(q, p) < least[q]
    ]
    rest = [r for r in rest if r[3] < r[4]]
    both = found.unionByName(search(rest, second)) if rest else found
    out = ranked(both, holders, pts, queries, k)
    fits = (F.col("score") < _MOST) & (F.col("score") > -_MOST)
    score = F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return out.withColumn("score", score)
