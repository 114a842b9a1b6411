"""Outlier handling: absorb, replace stale slots, merge the closest pair.

The rule is order dependent (outliers are handled one by one in arrival order),
so ``update_state`` runs it in ONE task that reads the state rows, the batch's
sums and then the outliers as a sorted stream: Spark's sort spills, the task
holds q micro-clusters and one Arrow batch of outliers, however many there are.
The result depends neither on partitions nor on batch sizes.

No point is lost: an outlier is absorbed by a micro-cluster made in this batch,
takes a stale slot, or the closest pair of the merge candidates makes room for
it (with fewer than two candidates the closest pair of all slots, those made in
this batch included; a single slot takes the outlier in).

Lineage: a slot keeps its primary id and the last id of its list; each merge
is one row (id, into, after) of a log (``operators.lineage``), so the state has
the same size after any number of merges.

The DataFrame forms ``replace_stale``, ``closest_pair`` and ``merge_pair``
express the individual steps with built-in operators.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probit import probit_py
from ..functions.vec import centroid, rmsd_formula, sqdist_sql
from ..params import STATE_SCHEMA, OnlineParams
from .assign import list_array, vectors_of
from .centers import CenterSearch
from .lineage import MERGE_FIELDS


def _rmsd(n, c1, c2) -> float:
    v = float(np.add.reduce(c2)) / n - float(np.add.reduce(c1 * c1)) / (n * float(n))
    return math.sqrt(v) if v > 0.0 else 0.0


def _nearest_nonzero(p, centers) -> float:
    if len(centers) == 0:
        return math.inf
    diff = centers - p
    d = np.einsum("ij,ij->i", diff, diff)
    d[d == 0.0] = np.inf
    return math.sqrt(d.min())


# ---------------------------------------------------------------------------
# sequential rule against the state


class ClosestPair:
    """Closest pair of some slots, kept up to date: each slot knows its nearest
    later slot. A moved center costs its own row and the rows that pointed at
    it; the others only look at the moved one. Ties go to the lowest (a, b)."""

    def __init__(self, slots: np.ndarray, centers: np.ndarray):
        self.slots, self.all = slots, centers
        self.own = centers[slots]
        k = len(slots)
        self.at = {int(s): i for i, s in enumerate(slots)}
        self.places = np.arange(k)
        self.near, self.mate = np.full(k, np.inf), np.full(k, -1, dtype=np.int64)
        self.changed: set[int] = set()
        for a in range(0, k, 64):
            self._rows(self.places[a : a + 64])

    def _rows(self, rows: np.ndarray) -> None:
        diff = self.own[None] - self.own[rows][:, None]
        d2 = np.einsum("ijk,ijk->ij", diff, diff)
        d2[self.places[None] <= rows[:, None]] = np.inf
        j = d2.argmin(axis=1)
        self.near[rows], self.mate[rows] = d2[self.places[: len(rows)], j], j

    def moved(self, slot: int) -> None:
        i = self.at.get(slot)
        if i is not None:
            self.changed.add(i)

    def best(self) -> tuple[int, int]:
        if self.changed:
            changed = np.array(sorted(self.changed))
            self.changed.clear()
            own, places = self.own, self.places
            own[changed] = self.all[self.slots[changed]]
            pointed = (self.mate[:, None] == changed).any(axis=1)
            pointed[changed] = False
            diff = own[None] - own[changed][:, None]
            d2 = np.einsum("ijk,ijk->ij", diff, diff)
            later = places > changed[:, None]
            # the moved ones as partners of earlier slots: the lowest of the nearest
            seen = np.where(places < changed[:, None], d2, np.inf)
            j = seen.argmin(axis=0)
            low, who = seen[j, places], changed[j]
            closer = (low < self.near) | ((low == self.near) & (who < self.mate))
            self.near[closer], self.mate[closer] = low[closer], who[closer]
            # their own partners, and those of the slots that pointed at them
            d2[~later] = np.inf
            j = d2.argmin(axis=1)
            self.near[changed], self.mate[changed] = d2[places[: len(changed)], j], j
            rows = pointed.nonzero()[0]
            for a in range(0, len(rows), 64):
                self._rows(rows[a : a + 64])
        a = int(self.near.argmin())
        return int(self.slots[a]), int(self.slots[self.mate[a]])


class OutlierRule:
    """The rule over the arrays of q slots, one outlier after the other.

    ``state``: numpy arrays sorted by slot: ids (list of lists: primary id, and
    the last of its list if there are more), n, cf1x (q, d), cf2x (q, d), cf1t,
    cf2t, centroid (q, d: the view at batch start), rmsd, stale. They are
    changed in place, the view as the batch goes on; the end-of-batch refresh
    is the caller's. ``merged`` holds the merges in order as (id, into, after):
    ``after`` is the last id of ``into``'s list before the merge."""

    def __init__(self, state: dict, t_factor: float, recursive: bool, next_id: int):
        self.s, self.t_factor, self.recursive, self.next_id = state, t_factor, recursive, next_id
        self.safe = [i for i in range(len(state["n"])) if state["stale"][i]]
        keep = [i for i in range(len(state["n"])) if not state["stale"][i]]
        self.keep = np.array(keep if len(keep) > 1 else range(len(state["n"])), dtype=np.int64)
        self.used = 0
        self.pairs: ClosestPair | None = None
        self.made: list[int] = []  # slots of the micro-clusters of this batch, in order
        self.place: dict[int, int] = {}
        self.centers = np.zeros_like(state["cf1x"])  # those of ``made``
        self.merged: list[tuple[int, int, int]] = []

    def _moved(self, i: int) -> None:
        s = self.s
        s["centroid"][i] = s["cf1x"][i] / s["n"][i]
        if i in self.place:
            self.centers[self.place[i]] = s["centroid"][i]
        if self.pairs is not None:
            self.pairs.moved(i)

    def _join(self, i: int, x, t: int) -> None:
        s = self.s
        s["n"][i] += 1
        s["cf1x"][i] += x
        s["cf2x"][i] += x * x
        s["cf1t"][i] += t
        s["cf2t"][i] += t * t
        if 2 * int(s["cf2t"][i]) >= 1 << 63:
            raise OverflowError("sums of squared ticks leave 64 bits: count ticks from a later origin or in longer intervals")
        self._moved(i)
        s["rmsd"][i] = _rmsd(int(s["n"][i]), s["cf1x"][i], s["cf2x"][i])

    def _take(self, i: int, x, t: int) -> None:
        s = self.s
        s["n"][i], s["cf1x"][i], s["cf2x"][i], s["cf1t"][i], s["cf2t"][i] = 1, x, x * x, t, t * t
        s["ids"][i] = [self.next_id]
        self.next_id += 1
        if i not in self.place:  # a slot taken again: its first place decides ties
            self.place[i] = len(self.made)
            self.made.append(i)
        self._moved(i)
        s["rmsd"][i] = _nearest_nonzero(s["centroid"][i], s["centroid"])

    def _merge(self) -> int:
        """Merge the closest pair; the slot that is free then."""
        s = self.s
        if self.pairs is None:
            self.pairs = ClosestPair(self.keep, s["centroid"])
        a, b = self.pairs.best()
        for f in ("n", "cf1x", "cf2x", "cf1t", "cf2t"):
            s[f][a] += s[f][b]
        ia, ib = s["ids"][a], s["ids"][b]
        self.merged.append((ib[0], ia[0], ia[-1]))
        s["ids"][a] = [ia[0], ib[-1]]
        self._moved(a)
        s["rmsd"][a] = _rmsd(int(s["n"][a]), s["cf1x"][a], s["cf2x"][a])
        return b

    def add(self, x: np.ndarray, t: int) -> None:
        m = len(self.made)
        if self.recursive and m:
            diff = self.centers[:m] - x
            d2 = np.einsum("ij,ij->i", diff, diff)
            k = int(np.argmin(d2))  # first minimum: order of creation, as a strict < scan
            i = self.made[k]
            if math.sqrt(d2[k]) <= self.t_factor * self.s["rmsd"][i]:
                self._join(i, x, t)
                return
        if self.used < len(self.safe):
            self.used += 1
            self._take(self.safe[self.used - 1], x, t)
        elif len(self.s["n"]) == 1:
            self._join(0, x, t)
        else:
            self._take(self._merge(), x, t)


def refresh_arrays(state: dict) -> dict:
    """End-of-batch refresh on arrays (same rule as ``features.refresh``)."""
    n, c1, c2 = state["n"], state["cf1x"], state["cf2x"]
    cen, rad = state["centroid"], state["rmsd"]
    for i in range(len(n)):
        if n[i] > 0:
            cen[i] = c1[i] / n[i]
        if n[i] > 1:
            rad[i] = _rmsd(n[i], c1[i], c2[i])
    alone = np.flatnonzero(n == 1).tolist()
    if alone:
        search = CenterSearch(cen)
        for i in alone:
            rad[i] = search.nearest_other(i)
    return state


# ---------------------------------------------------------------------------
# one-task state update of the online step

#: What a step's state rows carry besides the state: the first unused id, the
#: points folded and the broken rows met.
COUNT_FIELDS = [T.StructField(c, T.LongType()) for c in ("next_id", "n_batch", "n_broken")]

#: Rows of a step: the new state (kind "state") and its merges (kind "merge").
STEP_SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType())]
    + [T.StructField(f.name, f.dataType) for f in STATE_SCHEMA.fields]
    + COUNT_FIELDS
    + MERGE_FIELDS
)


def state_rows(step: DataFrame) -> DataFrame:
    """The state of a step as a table of ``STATE_SCHEMA``."""
    return step.where("kind = 'state'").select(*STATE_SCHEMA.fieldNames())


def merge_rows(step: DataFrame) -> DataFrame:
    """The merges of a step (id, into, after, seq)."""
    return step.where("kind = 'merge'").select(*(f.name for f in MERGE_FIELDS))


def _stamp_np(n, t1, t2, m):
    out = np.zeros(len(n))
    for i in range(len(n)):
        nd = float(n[i])
        mu = t1[i] / nd if nd > 0 else 0.0
        if nd < 2.0 * m:
            out[i] = mu
        else:
            sigma = math.sqrt(max(t2[i] / nd - mu * mu, 0.0))
            out[i] = mu + sigma * probit_py(1.0 - m / (2.0 * nd))
    return out


def _arrays(rows: list[dict], sums: list[dict]) -> dict:
    """The state rows (sorted by slot) with the batch's sums added."""
    rows = sorted(rows, key=lambda r: r["slot"])
    state = {
        "slot": np.array([r["slot"] for r in rows], dtype=np.int32),
        "ids": [list(r["ids"]) for r in rows],
        "n": np.array([r["n"] for r in rows], dtype=np.int64),
        "cf1x": np.array([r["cf1x"] for r in rows], dtype=np.float64),
        "cf2x": np.array([r["cf2x"] for r in rows], dtype=np.float64),
        "cf1t": np.array([r["cf1t"] for r in rows], dtype=np.int64),
        "cf2t": np.array([r["cf2t"] for r in rows], dtype=np.int64),
        "centroid": np.array([r["centroid"] for r in rows], dtype=np.float64),
        "rmsd": np.array([r["rmsd"] for r in rows], dtype=np.float64),
    }
    known = [r["next_id"] for r in rows if r["next_id"] is not None]
    state["next_id"] = known[0] if known else max((i for v in state["ids"] for i in v), default=-1) + 1
    state["n_broken"] = sum(r["n"] for r in sums if r["slot"] is None)
    sums = [r for r in sums if r["slot"] is not None]
    state["n_batch"] = sum(r["n"] for r in sums)
    at = {int(s): i for i, s in enumerate(state["slot"])}
    for r in sums:
        i = at[r["slot"]]
        state["n"][i] += r["n"]
        state["cf1x"][i] += np.array(r["cf1x"])
        state["cf2x"][i] += np.array(r["cf2x"])
        state["cf1t"][i] += r["cf1t"]
        state["cf2t"][i] += r["cf2t"]
    if max([float(v) for v in state["cf2t"]], default=0.0) >= 2.0**62:
        raise OverflowError("sums of squared ticks come near 64 bits: count ticks from a later origin or in longer intervals")
    return state


def _step_batch(state: dict, merged: list) -> pa.RecordBatch:
    q, k = len(state["n"]), len(merged)
    none = lambda t: pa.nulls(k, t)
    vec = pa.list_(pa.float64())
    both = lambda a, t: pa.concat_arrays([a.cast(t), none(t)])
    log = lambda v: pa.concat_arrays([pa.nulls(q, pa.int64()), pa.array(v, pa.int64())])
    columns = [
        pa.array(["state"] * q + ["merge"] * k),
        both(pa.array(state["slot"]), pa.int32()),
        both(pa.array(state["ids"], pa.list_(pa.int64())), pa.list_(pa.int64())),
        both(pa.array(state["n"]), pa.int64()),
        both(list_array(state["cf1x"]), vec),
        both(list_array(state["cf2x"]), vec),
        both(pa.array(state["cf1t"]), pa.int64()),
        both(pa.array(state["cf2t"]), pa.int64()),
        both(list_array(state["centroid"]), vec),
        both(pa.array(state["rmsd"]), pa.float64()),
        *(both(pa.array([state[f.name]] * q, pa.int64()), pa.int64()) for f in COUNT_FIELDS),
        log([m[0] for m in merged]), log([m[1] for m in merged]), log([m[2] for m in merged]), log(range(k)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=STEP_SCHEMA.fieldNames())


def update_state(state: DataFrame, sums: DataFrame | None, outliers: DataFrame | None, params: OnlineParams, now: int) -> DataFrame:
    """The whole end of an online step in ONE task: add the batch sums (ON9),
    stamp and split stale/keep (ON12/13), run the outlier rule over the
    ``outliers`` (seq_tick, seq_id, x) in arrival order (ON14-18) and refresh
    (ON10/11). Returns ``STEP_SCHEMA`` rows.

    ``state`` may carry ``next_id`` (the first unused id; without it the ids
    are taken to be whole lists). A row of ``sums`` without a slot counts broken
    rows of the batch. Without any points or broken rows there is no result.
    The data-sized work, the sums, runs distributed before it. Same rules as ``cf_apply``, ``with_staleness`` and
    ``refresh`` (which the tests compare it with).
    """
    fields = ["slot int", "ids array<bigint>", "n bigint", "cf1x array<double>", "cf2x array<double>", "cf1t bigint", "cf2t bigint",
              "centroid array<double>", "rmsd double", "next_id bigint", "seq_tick bigint", "seq_id bigint"]

    def branch(df: DataFrame, kind: int, **named) -> DataFrame:
        # one SQL string per column: a single JVM call builds each branch
        return df.selectExpr(f"CAST({kind} AS TINYINT) AS kind", *(
            f"CAST({named.get(c.split()[0], c.split()[0] if c.split()[0] in df.columns else 'NULL')} AS {c.split()[1]}) AS {c.split()[0]}" for c in fields
        ))

    rows = branch(state, 0)
    if sums is not None:
        rows = rows.union(branch(sums, 1))
    if outliers is not None:
        rows = rows.union(branch(outliers.select("seq_tick", "seq_id", "x"), 2, cf1x="x"))
    t_factor, recursive, m, delta, dim, step_rows = params.t_factor, params.recursive_outliers, params.m, params.delta, params.dim, params.max_candidates

    def kernel(batches):
        head: list[dict] = []
        rule = st = None

        def start():
            out = _arrays([r for r in head if r["kind"] == 0], [r for r in head if r["kind"] == 1])
            stamp = _stamp_np(out["n"], out["cf1t"], out["cf2t"], m)
            out["stale"] = (stamp < float(now - delta)) | (out["n"] == 0)
            return out

        for batch in batches:
            cut = int(np.searchsorted(batch.column("kind").to_numpy(zero_copy_only=False), 2))
            if cut:
                head.extend(batch.slice(0, cut).to_pylist())
            if cut == batch.num_rows:
                continue
            if rule is None:
                st = start()
                rule = OutlierRule(st, t_factor, recursive, st["next_id"])
            for a in range(cut, batch.num_rows, step_rows):
                part = batch.slice(a, min(step_rows, batch.num_rows - a))
                ticks = part.column("seq_tick").to_pylist()
                for x, t in zip(vectors_of(part, "cf1x", dim), ticks):
                    rule.add(x, t)
                st["n_batch"] += len(ticks)
        if st is None:
            st = start()
        if rule is not None:
            st["next_id"] = rule.next_id
        if st["n_batch"] or st["n_broken"]:
            yield _step_batch(refresh_arrays(st), rule.merged if rule else [])

    # the exchange keeps the batch's tasks apart from this one; equal rows of
    # equal keys are alike, so the order is total where it matters
    one = rows.repartition(1).sortWithinPartitions("kind", "seq_tick", "seq_id", "cf1x")
    return one.mapInArrow(kernel, STEP_SCHEMA)


def absorb_outliers(state: DataFrame, outliers: DataFrame, params: OnlineParams, now: int) -> DataFrame:
    """The outlier rule alone: ``outliers`` of a batch against a state."""
    return update_state(state, None, outliers, params, now)


# ---------------------------------------------------------------------------
# DataFrame forms of the single steps


def closest_pair(state_with_stale: DataFrame) -> DataFrame:
    """The non-stale pair (a < b) with the smallest squared centroid
    distance; ties go to the lowest (a, b). One row: slot_a, slot_b, d2.

    The keep centroids travel as ONE broadcast row; each slot a finds its
    best partner b > a in place, then a global min over q candidates."""
    keep = state_with_stale.where(~F.col("stale")).select("slot", "centroid")
    one = keep.agg(F.collect_list(F.struct(F.col("slot").alias("s"), F.col("centroid").alias("c"))).alias("_all"))
    best_b = F.expr(
        "array_min(transform(filter(_all, o -> o.s > slot), "
        f"o -> named_struct('d2', {sqdist_sql('centroid', 'o.c')}, 'slot_b', o.s)))"
    )
    per_a = keep.crossJoin(F.broadcast(one)).select(F.col("slot").alias("slot_a"), best_b.alias("_b"))
    cand = per_a.where(F.col("_b").isNotNull()).select(F.struct(F.col("_b.d2").alias("d2"), "slot_a", F.col("_b.slot_b").alias("slot_b")).alias("p"))
    best = cand.agg(F.min("p").alias("p"))
    return best.select("p.slot_a", "p.slot_b", "p.d2").where(F.col("slot_a").isNotNull())


def replace_stale(state_with_stale: DataFrame, outliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without absorption, the j-th outlier (arrival order) takes the j-th
    stale slot (slot order): fresh CF (x, x^2, t, t^2, 1), a new id, and as
    radius the distance to the nearest other centroid at that moment (slots
    taken before it count with their new centroid). Returns (state, the
    outliers for which no stale slot is left).

    Only min(#stale, #outliers) outliers are involved, so the outliers are cut
    to the first q by a top-k (never a global sort of the outliers).
    """
    q_bound = state_with_stale.where("stale").count()
    if q_bound == 0:
        return state_with_stale, outliers
    # outliers of one arrival key are told apart by their rank in it
    outliers = outliers.withColumn("_same", F.row_number().over(Window.partitionBy("seq_tick", "seq_id").orderBy("x")))
    first = outliers.orderBy("seq_tick", "seq_id", "_same").limit(q_bound)
    wr = Window.orderBy("seq_tick", "seq_id", "_same")
    ranked_out = first.withColumn("rank", F.row_number().over(wr))
    ranked_slots = state_with_stale.where("stale").select("slot").withColumn("rank", F.row_number().over(Window.orderBy("slot")))
    max_id = state_with_stale.select(F.max(F.array_max("ids")).alias("m"))
    pairs = ranked_slots.join(ranked_out, "rank").crossJoin(max_id).select(
        F.col("slot").alias("_slot"),
        F.col("rank").alias("_rank"),
        (F.col("m") + F.col("rank")).cast("long").alias("_new_id"),
        F.col("x").alias("_x"),
        F.col("seq_tick").alias("_t"),
        F.col("seq_id").alias("_i"),
        "_same",
    )
    j = state_with_stale.join(F.broadcast(pairs), F.col("slot") == F.col("_slot"), "left")
    # one row with every slot's centroid before and after its replacement
    view = j.agg(F.collect_list(F.struct("slot", "_rank", F.col("_x").alias("new"), F.col("centroid").alias("old"))).alias("_all"))
    seen = "transform(filter(_all, o -> o.slot <> slot), o -> IF(o._rank < _rank, o.new, o.old))"
    near = F.expr(f"sqrt(array_min(filter(transform({seen}, c -> {sqdist_sql('_x', 'c')}), d -> d <> 0.0)))")
    hit = F.col("_x").isNotNull()
    state = j.crossJoin(F.broadcast(view)).select(
        "slot",
        F.when(hit, F.array("_new_id")).otherwise(F.col("ids")).alias("ids"),
        F.when(hit, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"),
        F.when(hit, F.col("_x")).otherwise(F.col("cf1x")).alias("cf1x"),
        F.when(hit, F.transform("_x", lambda v: v * v)).otherwise(F.col("cf2x")).alias("cf2x"),
        F.when(hit, F.col("_t")).otherwise(F.col("cf1t")).alias("cf1t"),
        F.when(hit, F.col("_t") * F.col("_t")).otherwise(F.col("cf2t")).alias("cf2t"),
        F.when(hit, F.col("_x")).otherwise(F.col("centroid")).alias("centroid"),
        F.when(hit, F.coalesce(near, F.lit(float("inf")))).otherwise(F.col("rmsd")).alias("rmsd"),
        (F.col("stale") & ~hit).alias("stale"),
    )
    taken = pairs.select(F.col("_t").alias("seq_tick"), F.col("_i").alias("seq_id"), "_same")
    return state, outliers.join(F.broadcast(taken), ["seq_tick", "seq_id", "_same"], "left_anti").drop("_same")


def merge_pair(state: DataFrame, pair: DataFrame) -> DataFrame:
    """Merge slot_b into slot_a of ``pair`` (one row): every CF field added,
    ids concatenated (a's first), centroid and radius of the sum; slot b is
    left empty (n = 0, zero CFs, ids []), ready to be reused, and keeps its
    old centroid and radius until then."""
    p = F.broadcast(pair.select("slot_a", "slot_b"))
    j = state.crossJoin(p)
    b_rows = state.select(
        F.col("slot").alias("_bs"),
        F.col("ids").alias("_bids"),
        F.col("n").alias("_bn"),
        F.col("cf1x").alias("_b1"),
        F.col("cf2x").alias("_b2"),
        F.col("cf1t").alias("_bt1"),
        F.col("cf2t").alias("_bt2"),
    )
    j = j.join(F.broadcast(b_rows), F.col("_bs") == F.col("slot_b"), "left")
    is_a = F.col("slot") == F.col("slot_a")
    is_b = F.col("slot") == F.col("slot_b")
    zero = F.transform("cf1x", lambda v: F.lit(0.0))
    add = lambda c, o: F.zip_with(c, o, lambda x, y: x + y)
    out = j.select(
        "slot",
        F.when(is_a, F.concat("ids", "_bids")).when(is_b, F.array().cast("array<bigint>")).otherwise(F.col("ids")).alias("ids"),
        F.when(is_a, F.col("n") + F.col("_bn")).when(is_b, F.lit(0).cast("long")).otherwise(F.col("n")).alias("n"),
        F.when(is_a, add(F.col("cf1x"), F.col("_b1"))).when(is_b, zero).otherwise(F.col("cf1x")).alias("cf1x"),
        F.when(is_a, add(F.col("cf2x"), F.col("_b2"))).when(is_b, zero).otherwise(F.col("cf2x")).alias("cf2x"),
        F.when(is_a, F.col("cf1t") + F.col("_bt1")).when(is_b, F.lit(0).cast("long")).otherwise(F.col("cf1t")).alias("cf1t"),
        F.when(is_a, F.col("cf2t") + F.col("_bt2")).when(is_b, F.lit(0).cast("long")).otherwise(F.col("cf2t")).alias("cf2t"),
        "centroid",
        "rmsd",
        (is_a & (F.col("n") + F.col("_bn") > 0)).alias("_a"),
    )
    return out.select(
        *STATE_SCHEMA.fieldNames()[:7],
        F.when(F.col("_a"), centroid("n", "cf1x")).otherwise(F.col("centroid")).alias("centroid"),
        F.when(F.col("_a") & (F.col("n") > 1), rmsd_formula("n", "cf1x", "cf2x")).otherwise(F.col("rmsd")).alias("rmsd"),
    )
