"""Relevance stamp and staleness of micro-clusters (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probit import probit_sql


def relevance_stamp_sql(n: str = "n", cf1t: str = "cf1t", cf2t: str = "cf2t", m: int = 500) -> str:
    """Approximate time of arrival of the last m points.

    mu = cf1t/n, sigma = sqrt(cf2t/n - mu^2); the stamp is mu when n < 2m,
    else the (1 - m/(2n)) quantile of N(mu, sigma). sigma is clamped at 0.
    """
    nd = f"CAST({n} AS DOUBLE)"
    mu = f"(CASE WHEN {nd} > 0 THEN CAST({cf1t} AS DOUBLE) / {nd} ELSE 0.0 END)"
    sigma = f"sqrt(greatest(CAST({cf2t} AS DOUBLE) / {nd} - {mu} * {mu}, 0.0))"
    p = f"(1.0 - {float(m)!r} / (2.0 * {nd}))"
    return f"(CASE WHEN {nd} < {2.0 * m!r} THEN {mu} ELSE {mu} + {sigma} * {probit_sql(p)} END)"


def relevance_stamp(n: str = "n", cf1t: str = "cf1t", cf2t: str = "cf2t", m: int = 500) -> Column:
    return F.expr(relevance_stamp_sql(n, cf1t, cf2t, m))


def with_staleness(state: DataFrame, now, delta: int, m: int) -> DataFrame:
    """Add ``stamp`` and ``stale``: stale iff stamp < now - delta or n = 0."""
    now_c = now if isinstance(now, Column) else F.lit(int(now))
    s = state.withColumn("stamp", relevance_stamp("n", "cf1t", "cf2t", m))
    return s.withColumn("stale", (F.col("stamp") < (now_c - F.lit(delta)).cast("double")) | (F.col("n") == 0))
