"""Column expressions over ARRAY<DOUBLE> vectors.

These run JVM-side (higher-order functions). They are used on state-sized
tables (q rows) and in small plans; the per-point hot path uses the Arrow
kernel in ``operators.assign``. Each helper is built from one SQL string, so
building a plan costs one call into the JVM per expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _q(name: str) -> str:
    """Quote a plain column name; pass expressions (``m.c``, ``(…)``) through."""
    return f"`{name}`" if name.isidentifier() else name


def vadd_sql(a: str, b: str) -> str:
    return f"zip_with({_q(a)}, {_q(b)}, (x, y) -> x + y)"


def vsub_sql(a: str, b: str) -> str:
    return f"zip_with({_q(a)}, {_q(b)}, (x, y) -> x - y)"


def vsum_sql(a: str) -> str:
    return f"aggregate({_q(a)}, CAST(0.0 AS DOUBLE), (acc, x) -> acc + x)"


def vsquare_sql(a: str) -> str:
    return f"transform({_q(a)}, x -> x * x)"


def sqdist_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({_q(a)}, {_q(b)}, (x, y) -> (x - y) * (x - y)), CAST(0.0 AS DOUBLE), (acc, x) -> acc + x)"


def centroid_sql(n: str, cf1x: str) -> str:
    return f"CASE WHEN {_q(n)} > 0 THEN transform({_q(cf1x)}, x -> x / CAST({_q(n)} AS DOUBLE)) END"


def rmsd_sql(n: str, cf1x: str, cf2x: str) -> str:
    nd = f"CAST({_q(n)} AS DOUBLE)"
    return (
        f"sqrt(greatest({vsum_sql(cf2x)} / {nd} - "
        f"aggregate({_q(cf1x)}, CAST(0.0 AS DOUBLE), (acc, x) -> acc + x * x) / ({nd} * {nd}), 0.0))"
    )


def vadd(a: str, b: str) -> Column:
    return F.expr(vadd_sql(a, b))


def vsub(a: str, b: str) -> Column:
    return F.expr(vsub_sql(a, b))


def vsum(a: str) -> Column:
    return F.expr(vsum_sql(a))


def vsquare(a: str) -> Column:
    return F.expr(vsquare_sql(a))


def vdiv(a: str, s: str) -> Column:
    return F.expr(f"transform({_q(a)}, x -> x / CAST({_q(s)} AS DOUBLE))")


def sqdist(a: str, b: str) -> Column:
    """Squared Euclidean distance, accumulated left to right."""
    return F.expr(sqdist_sql(a, b))


def centroid(n: str, cf1x: str) -> Column:
    """cf1x / n (null when n == 0)."""
    return F.expr(centroid_sql(n, cf1x))


def rmsd_formula(n: str, cf1x: str, cf2x: str) -> Column:
    """Root mean squared deviation of a CF: sqrt(sum(cf2x)/n - sum(cf1x^2)/n^2).

    Clamped at 0: rounding can make the radicand slightly negative, which
    would otherwise turn the radius into NaN and reject every point.
    """
    return F.expr(rmsd_sql(n, cf1x, cf2x))


def array_sum_agg(col: str, dim: int, name: str | None = None) -> Column:
    """Element-wise SUM aggregate of a fixed-length array column.

    Expressed as ``dim`` scalar sums so Spark keeps partial (map-side)
    aggregation inside whole-stage codegen, then re-packed as an array.
    """
    parts = ", ".join(f"sum({_q(col)}[{i}])" for i in range(dim))
    return F.expr(f"array({parts})").alias(name or col)


def explode_vec(df, col: str, value_name: str, pos_name: str = "pos"):
    """(…, pos, value) rows of an array column (for comparisons / export)."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(col).alias(pos_name, value_name))
