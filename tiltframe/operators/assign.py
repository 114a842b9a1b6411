"""Nearest micro-cluster assignment (argmin of squared Euclidean distance).

Two forms:

* ``assign`` - the scale form: an Arrow kernel (``mapInArrow``) over the
  point batches. The centers are the q-row state view, collected once per
  batch with a size check (q x dim doubles, bounded by parameters, never by
  data) and shipped inside the task closure, the way MLlib ships k-means
  centers. Narrow: no shuffle, no row blow-up.
* ``assign_sql`` - the same rule written with built-in column functions over
  a one-row broadcast of the state (``array_min`` over ``struct(d2, slot)``),
  used to cross-check the kernel and for tiny inputs.

Ties go to the lowest slot (strict ``<`` while scanning slots in order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import sqdist_sql
from .centers import CenterSearch

MAX_VIEW_BYTES = 64 << 20
PACKED_BYTES = 1024


class CenterView:
    """Driver-side copy of a q-row center table: slot ids, centers, radii."""

    def __init__(self, slots, centers, rmsd=None):
        self.slots = np.asarray(slots, dtype=np.int32)
        self.centers = np.asarray(centers, dtype=np.float64)
        if self.centers.ndim == 1:
            self.centers = self.centers.reshape(len(self.slots), -1)
        self.rmsd = None if rmsd is None else np.asarray(rmsd, dtype=np.float64)

    @property
    def dim(self) -> int:
        return self.centers.shape[1]


def collect_view(centers_df: DataFrame, slot="slot", center="centroid", rmsd: str | None = "rmsd", max_rows=100_000) -> CenterView:
    """Collect a center table that is bounded by parameters (q or k rows).

    Refuses tables above ``max_rows`` rows or ``MAX_VIEW_BYTES``, so a data-
    sized table can never be pulled to the driver by mistake.
    """
    cols = [F.col(slot).cast("int").alias("s"), F.col(center).alias("c")]
    if rmsd:
        cols.append(F.col(rmsd).cast("double").alias("r"))
    rows = centers_df.where(F.col(center).isNotNull()).select(*cols).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"center table has more than {max_rows} rows; refusing to collect")
    rows.sort(key=lambda r: r["s"])
    if not rows:
        raise ValueError("no centers")
    C = np.array([r["c"] for r in rows], dtype=np.float64)
    if C.nbytes > MAX_VIEW_BYTES:
        raise ValueError("center view exceeds the broadcast bound")
    R = np.array([r["r"] if r["r"] is not None else 0.0 for r in rows], dtype=np.float64) if rmsd else None
    return CenterView([r["s"] for r in rows], C, R)


def vectors_of(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type):  # blocks of ``packed_points``
        arr = arr.cast(pa.large_binary())
        _, at, data = arr.buffers()
        if not len(arr):
            return np.zeros((0, dim))
        ends = np.frombuffer(at, np.int64, len(arr) + 1, 8 * arr.offset)
        return np.frombuffer(data, np.float64, int(ends[-1] - ends[0]) // 8, int(ends[0])).reshape(-1, dim)
    vals = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if vals.size != len(arr) * dim:
        raise ValueError(f"column {name} holds vectors whose length is not {dim}")
    return vals.reshape(len(arr), dim)


def list_array(mat: np.ndarray) -> pa.Array:
    n, d = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float64()))


def packed_points(points: DataFrame, dim: int, x: str = "x") -> DataFrame:
    """The vectors alone, as ``x BINARY``: doubles one after the other, about
    ``PACKED_BYTES`` of whole vectors a row (so that a batch of such rows stays
    small). For passes that come again: a batch is a matrix as it arrives,
    where arrays go through the JVM number by number. ``vectors_of`` reads it."""
    per = max(1, PACKED_BYTES // (8 * dim))

    def kernel(batches):
        for b in batches:
            X = vectors_of(b, x, dim)
            rows = [X[a : a + per].tobytes() for a in range(0, len(X), per)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    return points.select(x).mapInArrow(kernel, "x binary")


def assign(points: DataFrame, view: CenterView, x: str = "x", t_factor: float | None = None) -> DataFrame:
    """Add ``slot INT`` and ``d2 DOUBLE`` (and ``inside BOOLEAN`` when
    ``t_factor`` is given: ``sqrt(d2) <= t_factor * rmsd(slot)``)."""
    C, slots, R, dim = view.centers, view.slots, view.rmsd, view.dim
    with_inside = t_factor is not None
    if with_inside and R is None:
        raise ValueError("inside test needs the radii of the view")

    def kernel(batches):
        search = CenterSearch(C)
        for b in batches:
            X = vectors_of(b, x, dim)
            idx, d2 = search(X)
            cols = list(b.columns) + [pa.array(slots[idx], type=pa.int32()), pa.array(d2, type=pa.float64())]
            names = list(b.schema.names) + ["slot", "d2"]
            if with_inside:
                cols.append(pa.array(np.sqrt(d2) <= t_factor * R[idx], type=pa.bool_()))
                names.append("inside")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = list(points.schema.fields) + [T.StructField("slot", T.IntegerType()), T.StructField("d2", T.DoubleType())]
    if with_inside:
        fields.append(T.StructField("inside", T.BooleanType()))
    return points.mapInArrow(kernel, T.StructType(fields))


def state_row(centers_df: DataFrame, slot="slot", center="centroid", rmsd: str | None = "rmsd") -> DataFrame:
    """The center table collapsed to ONE row ``mcs ARRAY<STRUCT<slot,c,r>>``.
    Its size is q entries, so it is safe to broadcast."""
    parts = [F.col(slot).cast("int").alias("slot"), F.col(center).alias("c")]
    parts.append((F.col(rmsd).cast("double") if rmsd else F.lit(None).cast("double")).alias("r"))
    return centers_df.where(F.col(center).isNotNull()).agg(F.collect_list(F.struct(*parts)).alias("mcs"))


def assign_sql(points: DataFrame, centers_df: DataFrame, x: str = "x", t_factor: float | None = None, **kw) -> DataFrame:
    """Built-in-function form of ``assign`` (broadcast nested loop on one row)."""
    one = F.broadcast(state_row(centers_df, **kw))
    best = F.expr(f"array_min(transform(mcs, m -> named_struct('d2', {sqdist_sql(x, 'm.c')}, 'slot', m.slot, 'r', m.r)))")
    out = points.crossJoin(one).withColumn("_b", best)
    cols = [c for c in points.columns] + [F.col("_b.slot").alias("slot"), F.col("_b.d2").alias("d2")]
    if t_factor is not None:
        cols.append((F.sqrt(F.col("_b.d2")) <= F.lit(t_factor) * F.col("_b.r")).alias("inside"))
    return out.select(*cols)


def wssse(points: DataFrame, view: CenterView, x: str = "x") -> DataFrame:
    """Within-set sum of squared errors of given centers (one row)."""
    return assign(points, view, x).agg(F.sum("d2").alias("wssse"), F.count(F.lit(1)).alias("n"))
