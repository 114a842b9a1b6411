"""Inverse of the standard normal CDF as a plain column expression.

Spark has no built-in quantile function of the normal distribution, so the
relevance stamp uses P. J. Acklam's rational approximation (public; relative
error below 1.2e-9): three branches split at p = 0.02425 and 1 - 0.02425.
The same arithmetic is written in SQL for the DuckDB oracle
(``probit_sql``), so both sides agree to the last digit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's coefficients, in the published order.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
P_LOW = 0.02425


def _horner(coefs, x):
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def probit_py(p: float) -> float:
    """Scalar version (driver-side tests and pandas kernels)."""
    if not 0.0 < p < 1.0:
        return -math.inf if p <= 0 else math.inf
    if p < P_LOW:
        q = math.sqrt(-2.0 * math.log(p))
        return _horner(C, q) / (_horner(D, q) * q + 1.0)
    if p > 1.0 - P_LOW:
        q = math.sqrt(-2.0 * math.log(1.0 - p))
        return -_horner(C, q) / (_horner(D, q) * q + 1.0)
    q = p - 0.5
    r = q * q
    return _horner(A, r) * q / (_horner(B, r) * r + 1.0)


def _horner_col(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def probit(p: Column) -> Column:
    """Quantile of N(0,1) at probability ``p`` (0 < p < 1)."""
    ql = F.sqrt(F.lit(-2.0) * F.log(p))
    qu = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    qc = p - F.lit(0.5)
    r = qc * qc
    low = _horner_col(C, ql) / (_horner_col(D, ql) * ql + F.lit(1.0))
    high = -_horner_col(C, qu) / (_horner_col(D, qu) * qu + F.lit(1.0))
    mid = _horner_col(A, r) * qc / (_horner_col(B, r) * r + F.lit(1.0))
    return F.when(p < P_LOW, low).when(p > 1.0 - P_LOW, high).otherwise(mid)


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def probit_sql(p: str) -> str:
    """The same approximation as an ANSI SQL expression over ``p``."""
    ql = f"sqrt(-2.0 * ln({p}))"
    qu = f"sqrt(-2.0 * ln(1.0 - {p}))"
    qc = f"({p} - 0.5)"
    r = f"({qc} * {qc})"
    low = f"({_horner_sql(C, ql)} / ({_horner_sql(D, ql)} * {ql} + 1.0))"
    high = f"(-{_horner_sql(C, qu)} / ({_horner_sql(D, qu)} * {qu} + 1.0))"
    mid = f"({_horner_sql(A, r)} * {qc} / ({_horner_sql(B, r)} * {r} + 1.0))"
    return f"(CASE WHEN {p} < {P_LOW!r} THEN {low} WHEN {p} > {1.0 - P_LOW!r} THEN {high} ELSE {mid} END)"
