"""Offline phase: micro-clusters -> k macro-clusters.

Inputs are micro-cluster tables (q rows per request key), so every group
here is bounded by q; many requests run side by side, one group each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uniform import uniform
from ..functions.vec import centroid


def centers_and_weights(mcs: DataFrame, key: list[str] | None = None, keep: tuple = ()) -> DataFrame:
    """Micro-clusters with n > 0: ``center = cf1x / n``, ``weight = n / sum n``
    (per request key); ``keep`` carries more columns along."""
    key = key or []
    w = Window.partitionBy(*key) if key else Window.partitionBy()
    live = mcs.where(F.col("n") > 0)
    return live.select(
        *key,
        *keep,
        "slot",
        "n",
        centroid("n", "cf1x").alias("center"),
        (F.col("n").cast("double") / F.sum("n").over(w)).alias("weight"),
    )


def weight_intervals(cw: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cumulative [lo, hi) per center in slot order; equal centers are one
    item with the sum of their weights; the last interval is closed at 1."""
    key = key or []
    g = cw.groupBy(*key, "center").agg(F.min("slot").alias("slot"), F.sum("weight").alias("weight"))
    w = Window.partitionBy(*key).orderBy("slot") if key else Window.orderBy("slot")
    hi = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = g.select(*key, "slot", "center", "weight", hi.alias("hi"))
    out = out.withColumn("lo", F.col("hi") - F.col("weight"))
    mx = Window.partitionBy(*key) if key else Window.partitionBy()
    return out.withColumn("hi", F.when(F.col("slot") == F.max("slot").over(mx), F.lit(float("inf"))).otherwise(F.col("hi")))


def stream_of(key: list) -> int:
    """Stream number of a key's draws (0 without a key)."""
    out = 0
    for v in key:
        out = (out * 1_000_003 + int(v) + 1) % (1 << 31)
    return out


def weighted_sample(cw: DataFrame, num_points: int, seed: int | None = 42, key: list[str] | None = None, deterministic: bool = False) -> DataFrame:
    """``num_points`` draws with replacement by weight, as counts per center:
    rows ``key…, slot, center, draws`` with at least one draw. The draws are
    never rows: with ``deterministic`` (u = (i + 0.5)/N) the count of an
    interval has a closed form, else draw i is the counter-based number of
    index i (``functions.uniform``; every key has a stream of its own), met
    with the cumulative intervals of the key's group (its micro-clusters)."""
    key = key or []
    iv = weight_intervals(cw, key)
    if deterministic:
        upto = lambda c: F.ceil(F.col(c) * F.lit(float(num_points)) - F.lit(0.5)).cast("long")
        end = F.when(F.col("hi") >= 1.0, F.lit(num_points).cast("long")).otherwise(upto("hi"))
        out = iv.select(*key, "slot", "center", (end - F.greatest(upto("lo"), F.lit(0).cast("long"))).alias("draws"))
        return out.where("draws > 0").select(*key, "slot", "draws", "center")
    schema = T.StructType([*(iv.schema[k] for k in key), iv.schema["slot"], T.StructField("draws", T.LongType()), iv.schema["center"]])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        u = uniform(seed or 0, stream_of([pdf[k].iloc[0] for k in key]), np.arange(num_points))
        at = np.searchsorted(pdf["lo"].to_numpy(np.float64), u, side="right") - 1
        pdf = pdf.assign(draws=np.bincount(np.maximum(at, 0), minlength=len(pdf)))
        return pdf[pdf["draws"] > 0][[f.name for f in schema.fields]]

    grouped = iv.groupBy(*key) if key else iv.groupBy(F.lit(0).alias("_g"))
    return grouped.applyInPandas(fn, schema)


def _nearest(X, C):
    best = np.full(X.shape[0], np.inf)
    idx = np.zeros(X.shape[0], dtype=np.int64)
    for j in range(C.shape[0]):
        d = X - C[j]
        d2 = np.einsum("ij,ij->i", d, d)
        b = d2 < best
        best[b] = d2[b]
        idx[b] = j
    return idx, best


def lloyd(X: np.ndarray, w: np.ndarray, C0: np.ndarray, max_iter: int, tol: float):
    """Weighted Lloyd iterations; stops when no center moves more than tol.
    A center with no weight keeps its position."""
    C = C0.astype(np.float64).copy()
    for _ in range(max_iter):
        idx, _ = _nearest(X, C)
        moved = False
        for j in range(C.shape[0]):
            m = idx == j
            sw = w[m].sum()
            if sw > 0:
                nc = (w[m, None] * X[m]).sum(axis=0) / sw
                if float(np.sum((nc - C[j]) ** 2)) > tol * tol:
                    moved = True
                C[j] = nc
        if not moved:
            break
    idx, d2 = _nearest(X, C)
    return C, idx, d2


#: Rows of one request's group (q micro-clusters and k starts).
MAX_GROUP_ROWS = 200_000
MACRO_SCHEMA = "cluster int, center array<double>, weight double, cost double"


def macro_kmeans(points: DataFrame, k: int, max_iter: int = 20, tol: float = 1e-4, key: list[str] | None = None,
                 weight: str = "weight", init: DataFrame | None = None) -> DataFrame:
    """Weighted k-means over micro-cluster centers, one group per request
    key (each group holds at most q rows).

    Start: the ``init`` table (``key…, cluster, center``) when given, else
    the k heaviest centers (ties: lowest slot). Output per key: ``cluster,
    center, weight`` (assigned weight) and ``cost`` (weighted squared error).
    """
    key = key or []
    schema = T.StructType([*(points.schema[k_] for k_ in key), *T._parse_datatype_string(MACRO_SCHEMA).fields])
    pts = points.select(*key, F.lit(0).cast("byte").alias("_kind"), "slot", "center", F.col(weight).cast("double").alias("_w"))
    if init is not None:
        ini = init.select(*key, F.lit(1).cast("byte").alias("_kind"), F.col("cluster").cast("int").alias("slot"), "center", F.lit(0.0).alias("_w"))
        pts = pts.unionByName(ini)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_GROUP_ROWS:
            raise ValueError(f"a request holds more than {MAX_GROUP_ROWS} micro-clusters: use kmeans.batch_kmeans")
        p = pdf[pdf["_kind"] == 0].sort_values("slot")
        X = np.stack(p["center"].to_numpy()).astype(np.float64)
        w = p["_w"].to_numpy(np.float64)
        ini_rows = pdf[pdf["_kind"] == 1].sort_values("slot")
        if len(ini_rows):
            C0 = np.stack(ini_rows["center"].to_numpy()).astype(np.float64)
        else:
            order = np.lexsort((p["slot"].to_numpy(), -w))[:k]
            C0 = X[order]
        C, idx, d2 = lloyd(X, w, C0, max_iter, tol)
        out = pd.DataFrame(
            {
                "cluster": np.arange(C.shape[0], dtype=np.int32),
                "center": list(C),
                "weight": [float(w[idx == j].sum()) for j in range(C.shape[0])],
                "cost": float((w * d2).sum()),
            }
        )
        for k_ in key:
            out.insert(0, k_, pdf[k_].iloc[0])
        return out[[f.name for f in schema.fields]]

    grouped = pts.groupBy(*key) if key else pts.groupBy(F.lit(0).alias("_g"))
    return grouped.applyInPandas(fn, schema)


def sampled_macro_kmeans(mcs: DataFrame, k: int, num_points: int, max_iter: int = 20, seed: int = 42,
                         key: list[str] | None = None, deterministic: bool = False, tol: float = 1e-4) -> DataFrame:
    """k-means on ``num_points`` weighted draws of the micro-cluster centers,
    started at k further draws. Draws of the same center are the same point,
    so the sample is carried as draw counts (exactly the same iterations)."""
    key = key or []
    cw = centers_and_weights(mcs, key)
    sample = weighted_sample(cw, num_points, seed, key, deterministic)
    start = weighted_sample(cw, k, None if seed is None else seed + 1, key, deterministic)
    # expand the k start draws into k rows (k is a parameter, not data-sized)
    start_rows = start.select(*key, "center", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("_r"), "slot")
    w = Window.partitionBy(*key).orderBy("slot", "_r") if key else Window.orderBy("slot", "_r")
    init = start_rows.select(*key, "center", (F.row_number().over(w) - 1).alias("cluster"))
    return macro_kmeans(sample.withColumnRenamed("draws", "weight"), k, max_iter, tol, key, "weight", init)


def centers_csv(centers: DataFrame, center: str = "center", fmt: str | None = None) -> DataFrame:
    """One CSV line per center (``line``), keeping the other columns.
    Numbers print as Spark casts doubles, or with ``fmt`` (e.g. '%.6f')."""
    el = (lambda v: F.format_string(fmt, v)) if fmt else (lambda v: v.cast("string"))
    return centers.select(*[c for c in centers.columns if c != center], F.array_join(F.transform(center, el), ",").alias("line"))


def append_centers(centers: DataFrame, path: str, center: str = "center", fmt: str | None = None, batch: int | None = None) -> None:
    """Sink: add the CSV lines of the centers to a text folder. With ``batch``
    they are that batch's folder, which a replay overwrites; without it every
    call adds lines."""
    lines = centers_csv(centers, center, fmt).select("line").coalesce(1)
    if batch is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path.rstrip('/')}/batch={int(batch)}")
