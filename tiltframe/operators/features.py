"""Cluster-feature (CF) vectors: aggregate, apply, refresh; fused batch kernel.

A CF is additive: (n, sum x, sum x^2, sum t, sum t^2). Everything here is
either a keyed aggregate with map-side partial aggregation (data-sized
input, q-sized output) or arithmetic on the q-row state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import array_sum_agg, centroid, rmsd_formula, sqdist_sql, vadd, vsquare
from ..params import STATE_SCHEMA
from .assign import CenterView, list_array, vectors_of
from .centers import MAX_ROWS, CenterSearch


def check_ticks(t: np.ndarray, so_far: float = 0.0) -> None:
    """Raise before a sum of squared ticks could leave 64 bits."""
    if so_far + float((t.astype(np.float64) ** 2).sum()) >= 2.0**63:
        raise OverflowError("sums of squared ticks leave 64 bits: count ticks from a later origin or in longer intervals")


def cf_aggregate(assigned: DataFrame, dim: int, x: str = "x", tick: str | None = "tick", key: str = "slot") -> DataFrame:
    """Per key: n, cf1x = sum x, cf2x = sum x^2, cf1t = sum t, cf2t = sum t^2.

    ``dim`` scalar sums per vector field keep the aggregate codegen'd with
    partial aggregation before the shuffle (q rows per partition leave).
    """
    t = F.col(tick).cast("long") if tick else F.lit(0).cast("long")
    pre = assigned.select(F.col(key), F.col(x).alias("_x"), vsquare(x).alias("_x2"), t.alias("_t"))
    return pre.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        array_sum_agg("_x", dim, "cf1x"),
        array_sum_agg("_x2", dim, "cf2x"),
        F.sum("_t").cast("long").alias("cf1t"),
        F.sum(F.col("_t") * F.col("_t")).cast("long").alias("cf2t"),
    )


def cf_merge_partials(partials: DataFrame, dim: int, key: str = "slot") -> DataFrame:
    """Final aggregate of partial CF rows (same columns as ``cf_aggregate``)."""
    return partials.groupBy(key).agg(
        F.sum("n").cast("long").alias("n"),
        array_sum_agg("cf1x", dim, "cf1x"),
        array_sum_agg("cf2x", dim, "cf2x"),
        F.sum("cf1t").cast("long").alias("cf1t"),
        F.sum("cf2t").cast("long").alias("cf2t"),
    )


def cf_apply(state: DataFrame, sums: DataFrame) -> DataFrame:
    """state + sums per slot (slots without sums are unchanged)."""
    s = sums.select(
        "slot",
        F.col("n").alias("_n"),
        F.col("cf1x").alias("_c1"),
        F.col("cf2x").alias("_c2"),
        F.col("cf1t").alias("_t1"),
        F.col("cf2t").alias("_t2"),
    )
    j = state.join(s, "slot", "left")
    has = F.col("_n").isNotNull()
    return j.select(
        "slot",
        "ids",
        (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
        F.when(has, vadd("cf1x", "_c1")).otherwise(F.col("cf1x")).alias("cf1x"),
        F.when(has, vadd("cf2x", "_c2")).otherwise(F.col("cf2x")).alias("cf2x"),
        (F.col("cf1t") + F.coalesce("_t1", F.lit(0))).alias("cf1t"),
        (F.col("cf2t") + F.coalesce("_t2", F.lit(0))).alias("cf2t"),
        *[c for c in ("centroid", "rmsd") if c in state.columns],
    )


def nearest_other_distance(state: DataFrame, center: str = "centroid") -> DataFrame:
    """Per slot: distance to the nearest OTHER center (a distance of exactly
    0 is ignored; slots without any other center are left out).

    The q centers travel as ONE broadcast row (an array of q structs); each
    slot takes its minimum in place, so no slot x slot rows are produced."""
    live = state.where(F.col(center).isNotNull())
    one = live.agg(F.collect_list(F.struct(F.col("slot").alias("s"), F.col(center).alias("c"))).alias("_all"))
    d2 = F.expr(f"array_min(filter(transform(_all, o -> {sqdist_sql(center, 'o.c')}), d -> d <> 0.0))")
    out = live.crossJoin(F.broadcast(one)).select("slot", d2.alias("_d2"))
    return out.where(F.col("_d2").isNotNull()).select("slot", F.sqrt("_d2").alias("nn_dist"))


def refresh(state: DataFrame) -> DataFrame:
    """End-of-batch refresh of the view columns.

    centroid := cf1x/n when n > 0 (else kept); rmsd := CF formula when n > 1
    (else kept); then every singleton's rmsd := distance to the nearest
    other centroid (+inf if none).
    """
    s = state.select(
        *[c for c in state.columns if c not in ("centroid", "rmsd")],
        F.when(F.col("n") > 0, centroid("n", "cf1x")).otherwise(F.col("centroid")).alias("centroid"),
        F.when(F.col("n") > 1, rmsd_formula("n", "cf1x", "cf2x")).otherwise(F.col("rmsd")).alias("rmsd"),
    )
    nn = nearest_other_distance(s)
    return (
        s.join(nn, "slot", "left")
        .withColumn(
            "rmsd",
            F.when(F.col("n") == 1, F.coalesce(F.col("nn_dist"), F.lit(float("inf")))).otherwise(F.col("rmsd")),
        )
        .drop("nn_dist")
        .select(*STATE_SCHEMA.fieldNames())
    )


def empty_state(spark, centers: DataFrame, dim: int, center: str = "center") -> DataFrame:
    """q slots seeded with given centers (columns ``slot``, ``center``):
    n = 0, zero CFs, ids = [slot], rmsd 0."""
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    return centers.select(
        F.col("slot").cast("int").alias("slot"),
        F.array(F.col("slot").cast("long")).alias("ids"),
        F.lit(0).cast("long").alias("n"),
        zero.alias("cf1x"),
        zero.alias("cf2x"),
        F.lit(0).cast("long").alias("cf1t"),
        F.lit(0).cast("long").alias("cf2t"),
        F.col(center).cast("array<double>").alias("centroid"),
        F.lit(0.0).alias("rmsd"),
    )


# ---------------------------------------------------------------------------
# Fused batch kernel: assign + inside/outlier split + per-batch partial CFs


FUSED_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.ByteType()),  # 0: partial CF of inside points, 1: one outlier point
        T.StructField("slot", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("cf1x", T.ArrayType(T.DoubleType())),
        T.StructField("cf2x", T.ArrayType(T.DoubleType())),
        T.StructField("cf1t", T.LongType()),
        T.StructField("cf2t", T.LongType()),
        T.StructField("seq_tick", T.LongType()),
        T.StructField("seq_id", T.LongType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)


def assign_and_summarize(points: DataFrame, view: CenterView, t_factor: float | None, x="x", tick: str | None = "tick", order: str | None = "id", bad: str | None = None) -> DataFrame:
    """One narrow pass over the batch.

    Inside points are summed per slot across all Arrow batches of a task
    (map-side pre-aggregation: at most q rows leave a partition, whatever
    the skew of the slots); outliers stream out as single rows with their
    arrival key (``seq_tick``, ``seq_id``). ``t_factor=None``: every point
    is inside (first batch after an initialisation). Rows whose flag ``bad``
    holds are only counted, in one row of kind 2 a task. Without ``tick`` the
    points have no time (its sums are 0) and ``x`` may come packed
    (``packed_points``); ``order`` is for outliers.
    """
    C, slots, R, dim = view.centers, view.slots, view.rmsd, view.dim
    q = len(slots)
    if tick is None and t_factor is not None:
        raise ValueError("outliers need their tick")

    def kernel(batches):
        n = np.zeros(q, dtype=np.int64)
        s1 = np.zeros((q, dim))
        s2 = np.zeros((q, dim))
        t1 = np.zeros(q, dtype=np.int64)
        t2 = np.zeros(q, dtype=np.int64)
        broken = 0
        search = CenterSearch(C)

        def add(ii: np.ndarray, Xi: np.ndarray) -> None:
            n[:] += np.bincount(ii, minlength=q)
            for j in range(dim):
                s1[:, j] += np.bincount(ii, weights=Xi[:, j], minlength=q)
                s2[:, j] += np.bincount(ii, weights=Xi[:, j] * Xi[:, j], minlength=q)

        for b in batches:
            if bad is not None:
                whole = ~b.column(b.schema.get_field_index(bad)).to_numpy(zero_copy_only=False).astype(bool)
                broken += int((~whole).sum())
                b = b.filter(pa.array(whole))
            if b.num_rows == 0:
                continue
            X = vectors_of(b, x, dim)
            if tick is None:
                for a in range(0, len(X), MAX_ROWS):  # a packed batch has many points
                    Xi = X[a : a + MAX_ROWS]
                    add(search(Xi)[0], Xi)
                continue
            t = b.column(b.schema.get_field_index(tick)).to_numpy(zero_copy_only=False).astype(np.int64)
            idx, d2 = search(X)
            inside = np.ones(len(idx), dtype=bool) if t_factor is None else (np.sqrt(d2) <= t_factor * R[idx])
            ii, Xi, ti = idx[inside], X[inside], t[inside]
            add(ii, Xi)
            check_ticks(t, float(t2.max(initial=0)))
            np.add.at(t1, ii, ti)
            np.add.at(t2, ii, ti * ti)
            out = ~inside
            k = int(out.sum())
            if k:
                ids = b.column(b.schema.get_field_index(order)).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ones(k, dtype=np.int8)),
                        pa.array(slots[idx[out]], type=pa.int32()),
                        pa.array(np.ones(k, dtype=np.int64)),
                        pa.nulls(k, pa.list_(pa.float64())),
                        pa.nulls(k, pa.list_(pa.float64())),
                        pa.array(t[out]),
                        pa.array(t[out] * t[out]),
                        pa.array(t[out]),
                        pa.array(ids[out]),
                        list_array(X[out]),
                    ],
                    schema=_FUSED_ARROW,
                )
        present = np.nonzero(n)[0]
        k = present.size
        if broken:
            none = [pa.nulls(1, f.type) for f in _FUSED_ARROW]
            none[0], none[2] = pa.array([2], pa.int8()), pa.array([broken], pa.int64())
            yield pa.RecordBatch.from_arrays(none, schema=_FUSED_ARROW)
        if k:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(k, dtype=np.int8)),
                    pa.array(slots[present], type=pa.int32()),
                    pa.array(n[present]),
                    list_array(s1[present]),
                    list_array(s2[present]),
                    pa.array(t1[present]),
                    pa.array(t2[present]),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.list_(pa.float64())),
                ],
                schema=_FUSED_ARROW,
            )

    return points.select(*[c for c in (x, tick, order, bad) if c]).mapInArrow(kernel, FUSED_SCHEMA)


_FUSED_ARROW = pa.schema(
    [
        ("kind", pa.int8()),
        ("slot", pa.int32()),
        ("n", pa.int64()),
        ("cf1x", pa.list_(pa.float64())),
        ("cf2x", pa.list_(pa.float64())),
        ("cf1t", pa.int64()),
        ("cf2t", pa.int64()),
        ("seq_tick", pa.int64()),
        ("seq_id", pa.int64()),
        ("x", pa.list_(pa.float64())),
    ]
)
