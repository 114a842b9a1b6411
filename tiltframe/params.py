"""Parameters and schemas of the data model.

A micro-cluster is one row of the state table; the state of a model is a
q-row DataFrame. All vector fields are ARRAY<DOUBLE> of length ``dim``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

VEC = T.ArrayType(T.DoubleType(), containsNull=False)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("slot", T.IntegerType(), False),
        T.StructField("ids", T.ArrayType(T.LongType(), containsNull=False), False),
        T.StructField("n", T.LongType(), False),
        T.StructField("cf1x", VEC, False),
        T.StructField("cf2x", VEC, False),
        T.StructField("cf1t", T.LongType(), False),
        T.StructField("cf2t", T.LongType(), False),
        # derived view kept with the row: used by the next batch's assignment
        T.StructField("centroid", VEC, True),
        T.StructField("rmsd", T.DoubleType(), True),
    ]
)


@dataclass(frozen=True)
class OnlineParams:
    """Knobs of the online phase (defaults as in the reference model)."""

    q: int
    dim: int
    min_init_points: int = 0
    m: int = 500  # last m points used for the relevance stamp
    delta: int = 20  # staleness threshold in ticks
    t_factor: float = 2.0  # outlier radius factor
    recursive_outliers: bool = True
    init: str = "streaming"  # "random" | "kmeans" | "streaming" (ignored when min_init_points == 0)
    seed: int = 42
    # outliers taken from a batch's stream at a time (the result does not
    # depend on it)
    max_candidates: int = 2000
    max_broadcast_bytes: int = 64 << 20

    def __post_init__(self):
        if self.q < 1 or self.dim < 1:
            raise ValueError("q and dim must be positive")
        if self.init not in ("random", "kmeans", "streaming"):
            raise ValueError(f"unknown init route {self.init!r}")
        if self.max_candidates < 1 or self.max_candidates * self.dim * 8 > self.max_broadcast_bytes:
            raise ValueError("max_candidates x dim exceeds the broadcast bound")
        if self.q * self.dim * 8 * 3 > self.max_broadcast_bytes:
            raise ValueError("state view (q x dim) exceeds the broadcast bound")


@dataclass(frozen=True)
class SnapshotParams:
    """Pyramidal time frame: alpha^l + 1 snapshots kept per order."""

    alpha: int = 2
    l: int = 2

    def __post_init__(self):
        if self.alpha < 2 or self.l < 0:
            raise ValueError("alpha must be >= 2 and l >= 0")
