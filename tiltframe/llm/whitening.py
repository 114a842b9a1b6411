"""Whitening of a table of vectors with the components of their covariance.

The eigenvectors come from spectral divide-and-conquer: the polar factor U of
the shifted covariance V - s I (by the QR- and Cholesky-based dynamically
weighted Halley iteration, QDWH) gives the projector (U + I) / 2 on the
invariant subspace of the eigenvalues above s; a basis of it and of its
complement splits V into two smaller matrices, and so on down to single
components. Only halves that hold one of the wanted components are split.

What is data-sized runs on Spark: the distinct vectors (partial aggregates, so
a vector that a third of all rows hold sends one row a task), exact integer
sums, centred products per task added up per matrix row, and the last pass
that projects every row. The driver holds one d x d matrix per vector length
(``MAX_DIM`` bounds d); the mean and the d x k components travel to the tasks.

``fit`` returns the model of each vector length; ``whiten`` applies it.

Defined cases: rows whose vector is null or holds a null or non-finite entry
are left out; rows that repeat a vec_id or a vector each get their result, the
fit counts every different vector once; a null vec_id stays null; a number
beyond 64 bits after scaling counts as the nearest 64-bit number; vectors of
different lengths are fitted apart, each length with its own n and components;
empty vectors have no components and give no rows; a component without variance
(one vector, or fewer vectors than dimensions) has null ``whitened`` and takes
no part in ``identity_error``, ``explained`` is null where nothing varies;
``deviation`` is null where it leaves 64 bits; an empty table gives no rows;
only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

SCALE = 256
COMPONENTS = 4
MAX_DIM = 4096
_EPS = float(np.finfo(np.float64).eps)


# -- QDWH ----------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    m = len(a)
    alpha = np.linalg.norm(a)
    if alpha == 0:
        return np.eye(m)
    x = a / alpha
    try:
        low = 1.0 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(m))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, _EPS / 8)) if np.isfinite(low) else _EPS / 8
    eye = np.eye(m)
    for _ in range(40):
        l2 = low * low
        dd = np.cbrt(4.0 * (1.0 - l2) / (l2 * l2))
        s = np.sqrt(1.0 + dd)
        wa = s + 0.5 * np.sqrt(max(0.0, 8.0 - 4.0 * dd + 8.0 * (2.0 - l2) / (l2 * s)))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100.0:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:m] @ q[m:].T)
        else:
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2.0
        low = min(1.0, low * (wa + wb * l2) / (1.0 + wc * l2))
        moved, x = np.linalg.norm(new - x), new
        if abs(1.0 - low) < 10 * _EPS and moved <= _EPS ** (1 / 3):
            break
    return x


def _halves(a: np.ndarray, shift: float, rng) -> tuple[np.ndarray, int, float]:
    """(orthogonal basis, its columns that span the subspace above ``shift``,
    norm of what couples the two)."""
    m = len(a)
    p = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2.0
    k = int(round(float(np.trace(p))))
    if not 0 < k < m:
        return np.eye(m), k, np.inf
    g = rng.standard_normal((m, m))
    for _ in range(2):
        g, _ = np.linalg.qr(np.hstack([p @ g[:, :k], g[:, k:] - p @ g[:, k:]]))
    return g, k, float(np.linalg.norm(g[:, :k].T @ a @ g[:, k:]))


def top_components(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues (falling) and their eigenvectors
    (columns) of a symmetric matrix, by spectral divide-and-conquer."""
    rng = np.random.default_rng(0)
    scale = float(np.linalg.norm(a))
    done: list[tuple[float, np.ndarray]] = []

    def split(b: np.ndarray, basis: np.ndarray, want: int) -> None:
        m = len(b)
        mean = float(np.trace(b)) / m
        if m == 1 or np.linalg.norm(b - mean * np.eye(m)) <= 4 * _EPS * scale:
            done.extend((float(b[i, i]), basis[:, i]) for i in range(m))
            return
        # the mean lies strictly between the extremes: that split always exists
        diagonal = np.sort(np.diag(b))
        best = None
        for shift in [float(np.median(diagonal)), mean, *rng.uniform(diagonal[0], diagonal[-1], 6), *(mean + scale * np.array([1e-3, -1e-3, 1e-6, -1e-6]))]:
            found = _halves(b, shift, rng)
            if best is None or found[2] < best[2]:
                best = found
            if found[2] <= 8 * _EPS * np.sqrt(m) * scale:
                break
        q, k, off = best
        if not np.isfinite(off):  # equal up to rounding
            done.extend((float(b[i, i]), basis[:, i]) for i in range(m))
            return
        for cols, left in ((q[:, :k], want), (q[:, k:], want - k)):
            if left > 0:
                c = cols.T @ b @ cols
                split((c + c.T) / 2.0, basis @ cols, left)

    if len(a):
        split((a + a.T) / 2.0, np.eye(len(a)), want)
    pairs = sorted(((float(v @ a @ v), v) for _, v in done), key=lambda p: -p[0])[:want]
    if not pairs:
        return np.zeros(0), np.zeros((len(a), 0))
    vectors = np.array([v if v[np.argmax(np.abs(v))] > 0 else -v for _, v in pairs]).T
    return np.array([e for e, _ in pairs]), vectors


# -- the model -------------------------------------------------------------------


@dataclass
class Whitening:
    """Model of one vector length: ``n`` vectors with exact ``sums``; ``vectors``
    (d x k) are unit columns, ``values`` their variances, ``trace`` the whole."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def live(self) -> np.ndarray:
        """Components that have a variance beyond rounding."""
        return self.values > 64 * _EPS * max(self.trace, 0.0) * max(1, len(self.sums)) ** 0.5

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component over its deviation (NaN: no variance)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live(), centred(x, self.n, self.sums) @ self.vectors / np.sqrt(np.where(self.live(), self.values, 1.0)), np.nan)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: int64 where that is safe, else Python integers."""
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1, max((abs(s) for s in sums), default=0) // max(n, 1) + 1)
    if most * n < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, from exact numerators."""
    return _numerators(x, n, sums).astype(np.float64) / float(n)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    num = _numerators(x, n, sums)
    if num.dtype != object and (float(np.abs(num.astype(np.float64)).max(initial=0.0)) ** 2) * max(1, num.shape[1]) < 2.0**62:
        return (num * num).sum(axis=1).tolist()
    return [d if d < 1 << 63 else None for d in (sum(int(v) * int(v) for v in row) for row in num)]


# -- passes over the table ----------------------------------------------------------


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the whole vectors: x = floor(scale * entry)."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    entry = lambda c: F.when(c * float(scale) >= 2.0**63, high).when(c * float(scale) < -(2.0**63), low).otherwise(F.floor(c * float(scale)))
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).where(whole).select("vec_id", F.transform("v", entry).alias("x"))


def _by_length(batch: pa.RecordBatch):
    """(rows, matrix) for each vector length of a batch; empty ones not."""
    x = batch.column("x")
    size = np.diff(np.asarray(x.offsets))
    flat = x.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    for d in np.unique(size):
        if d:
            rows = np.flatnonzero(size == d)
            yield int(d), rows, flat[start[rows][:, None] + np.arange(d)]


def _sums_fn(batches):
    n: dict = {}
    high: dict = {}
    low: dict = {}
    for batch in batches:
        for d, rows, x in _by_length(batch):
            n[d] = n.get(d, 0) + len(rows)
            # two halves of 32 bits: their sums stay far from 64 bits
            high[d] = high.get(d, 0) + (x >> 32).sum(axis=0)
            low[d] = low.get(d, 0) + (x & 0xFFFFFFFF).sum(axis=0)
    for d in n:
        s = [Decimal((int(a) << 32) + int(b)) for a, b in zip(high[d], low[d])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array(s, pa.decimal128(38, 0))],
            names=["d", "i", "n", "s"],
        )


def _products_fn(means: dict):
    def fn(batches):
        acc: dict = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                c = centred(x, *means[d])
                acc[d] = acc.get(d, 0.0) + c.T @ c
        for d, m in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["d", "i", "row"])

    return fn


def _add_rows(key, table):
    rows = table.column("row").combine_chunks()
    total = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})


def _spread_fn(models: dict):
    """One row a task and length: count, mean and centred products of the
    whitened vectors."""

    def fn(batches):
        acc: dict = {}
        for batch in batches:
            for d, rows, x in _by_length(batch):
                w = models[d].project(x)[:, models[d].live()]
                acc[d] = _joined(acc.get(d), (len(rows), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        for d, (n, mean, m2) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([m2.ravel()], pa.list_(pa.float64()))], names=["d", "n", "mean", "m2"])

    return fn


def _joined(a, b):
    """(n, mean, centred products) of two disjoint parts together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_fn(key, table):
    acc = None
    for r in table.to_pylist():  # one row a task
        mean = np.array(r["mean"], dtype=np.float64)
        acc = _joined(acc, (r["n"], mean, np.array(r["m2"], dtype=np.float64).reshape(len(mean), len(mean))))
    n, mean, m2 = acc
    error = float(np.abs(m2 / n - np.eye(len(mean))).max(initial=0.0))
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "error": pa.array([error], pa.float64())})


def fit(spark: SparkSession, x: DataFrame, components: int = COMPONENTS, scratch: Scratch | None = None) -> dict[int, Whitening]:
    """Model per vector length of ``x`` (column x array<long>), each different
    vector counted once."""
    scratch = scratch or Scratch(spark, "whitening")
    each = scratch.keep(x.select("x").where(F.size("x") > 0).distinct(), "vectors", free=True)
    longest = each.agg(F.max(F.size("x"))).first()[0] or 0
    if longest > MAX_DIM:
        raise ValueError(f"vectors of {longest} entries: the covariance of more than {MAX_DIM} does not go through the driver")
    means: dict = {}
    sums = each.mapInArrow(_sums_fn, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in sums.orderBy("d", "i").collect():  # one row a dimension
        means.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    cov = {d: np.zeros((d, d)) for d in means}
    rows = each.mapInArrow(_products_fn(means), "d int, i int, row array<double>").groupBy("d", "i").applyInArrow(_add_rows, "d int, i int, row array<double>")
    for r in rows.collect():  # d rows of d numbers
        cov[r["d"]][r["i"]] = r["row"]
    models = {}
    for d, (n, s) in means.items():
        v = cov[d] / n
        values, vectors = top_components(v, min(components, d))
        models[d] = Whitening(n, s, values, vectors, float(np.trace(v)))
    for r in each.mapInArrow(_spread_fn(models), "d int, n long, mean array<double>, m2 array<double>").groupBy("d").applyInArrow(_identity_fn, "d int, error double").collect():
        models[r["d"]].identity_error = r["error"]
    return models


def _whiten_fn(models: dict):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def fn(batches):
        for batch in batches:
            for d, rows, x in _by_length(batch):
                m = models[d]
                k, count = len(m.values), len(rows)
                w = m.project(x).ravel()
                of = np.repeat(rows, k)
                share = [float(e) / m.trace if m.trace > 0 else None for e in m.values]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(of)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                        pa.array(np.full(k * count, m.n, dtype=np.int64)),
                        pa.array([v for v in _deviations(x, m.n, m.sums) for _ in range(k)], pa.int64()),
                        pa.array(w, pa.float64(), mask=np.isnan(w)),
                        pa.array(share * count, pa.float64()),
                        pa.array([m.identity_error] * (k * count), pa.float64()),
                    ],
                    names=names,
                )

    return fn


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per whole vector and component: ``whitened`` and what the fit
    says of the component and of the row (module docstring)."""
    scratch = Scratch(spark, "whitening")
    x = scaled(vectors, id_col, vec_col, scale)
    models = fit(spark, x, components, scratch)
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return x.where(F.size("x") > 0).mapInArrow(_whiten_fn(models), schema)
