"""k-means baselines: batch k-means with its cost, streaming k-means with
forgetting (also the default initialisation route of the online phase).

Batch k-means is ``kmeans_parallel`` (a start by oversampled D^2 rounds) and
``lloyd`` (rounds from a given start). Every random choice is a counter-based
draw that belongs to a row (``functions.uniform``), so a run does not depend on
partitions, can be repeated, and SQL can repeat it. A round reads the points
once, sums leave the tasks per center, and its model, k rows, is written to
the shared folder: a restarted job goes on with the round it was in.

The model of streaming k-means is a k-row DataFrame ``slot, center, weight``;
one update is the assignment kernel + a keyed aggregate (data-sized, partial
aggregation) followed by arithmetic on k rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uniform import gaussian, uniform, uniform_col
from ..functions.vec import array_sum_agg
from ..session import new_run_dir, path_exists
from .assign import CenterView, assign, collect_view, list_array, packed_points, vectors_of
from .centers import nearest
from .features import assign_and_summarize, cf_merge_partials


def random_gaussian_model(k: int, dim: int, seed: int, weight: float = 0.0):
    """Driver-side start model: k centers with N(0,1) coordinates (k x dim
    counter-based draws: stream = coordinate, index = slot), all with the same
    weight."""
    slots = np.arange(k)
    centers = np.stack([gaussian(seed, j, slots) for j in range(dim)], axis=1)
    return slots.astype(np.int32), centers, np.full(k, float(weight))


def random_uniform_centers(spark: SparkSession, k: int, dim: int, seed: int) -> DataFrame:
    """``slot, center``: coordinates uniform in (0, 1), drawn alike."""
    return spark.range(k).select(F.col("id").cast("int").alias("slot"), F.array(*[uniform_col(seed, j, "id") for j in range(dim)]).alias("center"))


def random_gaussian_centers(spark: SparkSession, k: int, dim: int, seed: int, weight: float = 0.0) -> DataFrame:
    """The same start model as a k-row DataFrame ``slot, center, weight``."""
    slots, C, w = random_gaussian_model(k, dim, seed, weight)
    rows = [(int(s), [float(v) for v in c], float(x)) for s, c, x in zip(slots, C, w)]
    return spark.createDataFrame(rows, "slot int, center array<double>, weight double")


def decay_from_half_life(half_life: float) -> float:
    return math.exp(math.log(0.5) / half_life)


def model_arrays(model) -> tuple:
    """(slots, centers, weights) of a model given as a k-row DataFrame or as
    arrays. The DataFrame is bounded by k; ``collect_view`` checks it."""
    if isinstance(model, DataFrame):
        view = collect_view(model, "slot", "center", "weight")
        return view.slots, view.centers, view.rmsd
    slots, C, w = model
    return np.asarray(slots, dtype=np.int32), np.asarray(C, dtype=np.float64), np.asarray(w, dtype=np.float64)


def streaming_kmeans_update(model, batch: DataFrame, decay: float = 1.0, time_unit: str = "batches", x: str = "x",
                            with_total: bool = False) -> DataFrame:
    """One update of streaming k-means with forgetting.

    discount a = decay (per batch) or decay^(points in batch);
    w' = a w + n_j; c' = (1 - l) c + (l / n_j) sum_j with l = n_j / max(w', 1e-16).
    Then, if the lightest weight is below 1e-8 of the heaviest, the heaviest
    center is split in two (+-1e-14 max(|c|, 1) per coordinate) and both get
    the mean of the two weights.

    ``model``: k-row DataFrame ``slot, center, weight`` or driver arrays
    (slots, centers, weights) - k x d numbers, as MLlib keeps them. The
    data-sized part (assignment + per-center sums) runs distributed with
    partial aggregation; the k-row update is one small task. ``with_total``
    adds ``batch_points`` (points in the batch) to every row.
    """
    if time_unit not in ("batches", "points"):
        raise ValueError("time_unit must be 'batches' or 'points'")
    slots, C0, w0 = model_arrays(model)
    view = CenterView(slots, C0)
    dim = view.dim
    sums = (
        assign(batch.select(x), view, x)
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("cnt"), array_sum_agg(x, dim, "sx"))
    )

    def fn(batches):
        frames = [b for b in batches if len(b)]
        st = {}
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                st[int(r.slot)] = (int(r.cnt), np.asarray(r.sx, dtype=np.float64))
        C = C0.copy()
        w = w0.copy()
        total = sum(c for c, _ in st.values())
        a = decay if time_unit == "batches" else decay ** total
        w = w * a
        for i, slot in enumerate(slots):
            if int(slot) in st:
                cnt, sx = st[int(slot)]
                w1 = w[i] + cnt
                lam = cnt / max(w1, 1e-16)
                w[i] = w1
                C[i] = (1.0 - lam) * C[i] + (lam / cnt) * sx
        big, small = int(np.argmax(w)), int(np.argmin(w))
        if w[small] < 1e-8 * w[big]:
            mean = (w[big] + w[small]) / 2.0
            w[big] = w[small] = mean
            cl = C[big].copy()
            pert = 1e-14 * np.maximum(np.abs(cl), 1.0)
            C[big] = cl + pert
            C[small] = cl - pert
        out = pd.DataFrame({"slot": slots.astype(np.int32), "center": list(C), "weight": w})
        if with_total:
            out["batch_points"] = np.int64(total)
        yield out

    schema = "slot int, center array<double>, weight double" + (", batch_points bigint" if with_total else "")
    return sums.coalesce(1).mapInPandas(fn, schema)


def batch_kmeans(points: DataFrame, k: int, max_iter: int = 20, seed: int = 42, x: str = "x", weight: str | None = None, tol: float = 1e-4):
    """pyspark.ml k-means (k-means|| init). Returns (centers DataFrame
    ``slot, center``, training cost)."""
    feats = points.select(array_to_vector(F.col(x)).alias("features"), *([F.col(weight).cast("double").alias("w")] if weight else []))
    km = KMeans(k=k, maxIter=max_iter, seed=seed, tol=tol, featuresCol="features")
    if weight:
        km = km.setWeightCol("w")
    model = km.fit(feats)
    spark = points.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "slot int, center array<double>"
    )
    return centers, float(model.summary.trainingCost)


# -- start by oversampled D^2 rounds -------------------------------------------

_DRAWN = "u double, id long, x array<double>"


def _drawn_batch(u, ids, X) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(ids), list_array(X)], names=["u", "id", "x"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_fn(seed: int, dim: int):
    """The row of least draw of a task."""

    def fn(batches):
        best = None
        for b in batches:
            if b.num_rows:
                ids, X = _ids(b), vectors_of(b, "x", dim)
                u = uniform(seed, 0, ids)
                i = int(np.lexsort((ids, u))[0])
                if best is None or (u[i], ids[i]) < best[:2]:
                    best = (u[i], ids[i], X[i])
        if best is not None:
            yield _drawn_batch([best[0]], [best[1]], best[2][None, :])

    return fn


def _cost_fn(centers: np.ndarray):
    def fn(batches):
        total = sum(float(nearest(vectors_of(b, "x", centers.shape[1]), centers)[1].sum()) for b in batches if b.num_rows)
        # a task without rows has the integer 0, which is no double to Spark
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], names=["cost"])

    return fn


def _pick_fn(seed: int, round_: int, centers: np.ndarray, scale: float):
    """Rows whose draw lies below scale x (squared distance to the centers)."""

    def fn(batches):
        for b in batches:
            if b.num_rows:
                ids, X = _ids(b), vectors_of(b, "x", centers.shape[1])
                u = uniform(seed, round_, ids)
                hit = u < scale * nearest(X, centers)[1]
                yield _drawn_batch(u[hit], ids[hit], X[hit])

    return fn


def _weight_fn(centers: np.ndarray):
    def fn(batches):
        n = np.zeros(len(centers), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(nearest(vectors_of(b, "x", centers.shape[1]), centers)[0], minlength=len(centers))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["c", "n"])

    return fn


def weighted_seeds(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> list[int]:
    """k-means++ on few weighted candidates: draw j (stream 1000 + j) picks by
    weight times squared distance to the nearest one picked, by a walk along
    the cumulative sums. Fewer than ``k`` where no distance is left."""
    chosen: list[int] = []
    d2 = np.ones(len(candidates))
    for j in range(k):
        cum = np.cumsum(weights * d2)
        if not len(cum) or cum[-1] <= 0:
            break
        i = int(np.searchsorted(cum, float(uniform(seed, 1000 + j, 0)) * cum[-1], side="right"))
        i = min(i, len(cum) - 1)
        chosen.append(i)
        diff = candidates - candidates[i]
        new = np.einsum("ij,ij->i", diff, diff)
        d2 = new if j == 0 else np.minimum(d2, new)
    return chosen


def kmeans_parallel(points: DataFrame, k: int, seed: int = 42, rounds: int = 2, oversample: int | None = None, x: str = "x", ident: str = "id", folder: str | None = None) -> DataFrame:
    """``slot, center``: a start for k-means by k-means|| oversampling.

    The row of least draw (stream 0) is the first candidate. In round r each
    row is drawn (stream r, index ``ident``) with probability min(1, l d2 /
    cost), l = ``oversample`` (2 k): about l rows a round, whatever the table's
    size. Candidates are weighted by the rows nearest to them and reduced to k
    by ``weighted_seeds``. ``ident`` numbers the rows (equal numbers get equal
    draws). Fewer centers where the points are fewer than k different ones."""
    spark = points.sparkSession
    folder = folder or new_run_dir(spark, "kmeans-start")
    done = f"{folder}/start"
    schema = "slot int, center array<double>"
    if path_exists(spark, f"{done}/_SUCCESS"):
        return spark.read.schema(schema).parquet(done)
    pts = points.select(F.col(ident).cast("long").alias("id"), F.col(x).alias("x"))
    ell = oversample or 2 * k
    head = pts.limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    dim = len(head[0]["x"])
    first = pts.mapInArrow(_first_fn(seed, dim), _DRAWN).orderBy("u", "id").limit(1).collect()
    candidates = np.array([first[0]["x"]], dtype=np.float64)
    for r in range(1, rounds + 1):
        cost = pts.mapInArrow(_cost_fn(candidates), "cost double").agg(F.sum("cost")).first()[0]
        if not cost:
            break
        most = 20 * ell + 1000  # about ell are expected; more cannot be a matter of chance
        rows = pts.mapInArrow(_pick_fn(seed, r, candidates, ell / cost), _DRAWN).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("many rows share few ids: their draws are not independent")
        rows.sort(key=lambda w: (w["id"], w["x"]))
        if rows:
            candidates = np.vstack([candidates, np.array([w["x"] for w in rows], dtype=np.float64)])
    weights = np.zeros(len(candidates))
    for w in pts.mapInArrow(_weight_fn(candidates), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        weights[w["c"]] = w["n"]
    chosen = weighted_seeds(candidates, weights, k, seed)
    out = spark.createDataFrame([(i, [float(v) for v in candidates[c]]) for i, c in enumerate(chosen)], schema)
    out.coalesce(1).write.mode("overwrite").parquet(done)
    return spark.read.schema(schema).parquet(done)


def lloyd(points: DataFrame, centers: DataFrame, max_iter: int = 20, tol: float = 1e-4, x: str = "x", folder: str | None = None) -> DataFrame:
    """``slot, center`` after at most ``max_iter`` rounds of k-means from given
    centers; it stops once no center moves farther than ``tol`` (0: at a fixed
    point). A center that no point is nearest to stays. Each round's model is
    a table ``round-<i>`` of ``folder``; a run that finds some goes on there.
    ``points`` is read once: the rounds read the vectors alone, packed, from
    the table ``points`` of ``folder``."""
    spark = points.sparkSession
    folder = folder or new_run_dir(spark, "kmeans")
    view = collect_view(centers, "slot", "center", None)
    out = centers.select("slot", "center")
    for i in range(max_iter):
        path = f"{folder}/round-{i}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            packed = f"{folder}/points"
            if not path_exists(spark, f"{packed}/_SUCCESS"):
                packed_points(points, view.dim, x).write.mode("overwrite").option("compression", "zstd").parquet(packed)
            fused = assign_and_summarize(spark.read.schema("x binary").parquet(packed), view, None, tick=None, order=None)
            sums = cf_merge_partials(fused.where("kind = 0").select("slot", "n", "cf1x", "cf2x", "cf1t", "cf2t"), view.dim).collect()  # k rows
            new = view.centers.copy()
            at = {int(s): j for j, s in enumerate(view.slots)}
            for r in sums:
                new[at[r["slot"]]] = np.array(r["cf1x"]) / r["n"]
            rows = [(int(s), [float(v) for v in c]) for s, c in zip(view.slots, new)]
            spark.createDataFrame(rows, "slot int, center array<double>").coalesce(1).write.mode("overwrite").parquet(path)
        out = spark.read.schema("slot int, center array<double>").parquet(path)
        old, view = view, collect_view(out, "slot", "center", None)
        if float(np.sqrt(((view.centers - old.centers) ** 2).sum(axis=1)).max()) <= tol:
            break
    return out


def kmeans_cost(points: DataFrame, centers: DataFrame, x: str = "x") -> DataFrame:
    """WSSSE of given centers: sum over points of the squared distance to the
    nearest center (one row ``wssse, n``)."""
    view = collect_view(centers, "slot", "center", None)
    return assign(points.select(x), view, x).agg(F.sum("d2").alias("wssse"), F.count(F.lit(1)).alias("n"))


__all__ = [
    "random_gaussian_centers",
    "decay_from_half_life",
    "streaming_kmeans_update",
    "batch_kmeans",
    "kmeans_parallel",
    "lloyd",
    "random_uniform_centers",
    "kmeans_cost",
]
