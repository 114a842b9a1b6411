"""Counter-based uniform numbers: (seed, stream, index) -> a double in (0, 1).

The same integer arithmetic in NumPy, as a Spark SQL expression and as a
DuckDB one, so a draw belongs to a row and not to a partition or a task: a
replay, another partitioning or another engine draws the same numbers. Every
product stays below 2^63, so nothing overflows in checked arithmetic.

The key words (seed, stream, the index's two halves of 32 bits) go through two
multiply / shift rounds each; two such hashes give 52 bits, and half a unit is
added so that neither 0 nor 1 occurs (logarithms are safe).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_MUL = 0x45D9F3B
_MASK = 0xFFFFFFFF


def _key(seed: int, half: int) -> int:
    return (2 * int(seed) + half) & _MASK


def _hash_np(seed: int, half: int, stream, index: np.ndarray) -> np.ndarray:
    mul, mask, s16 = np.uint64(_MUL), np.uint64(_MASK), np.uint64(16)
    idx = np.asarray(index, dtype=np.int64)
    words = [
        np.uint64(_key(seed, half)), np.uint64(0), np.asarray(stream, dtype=np.int64).astype(np.uint64) & mask, np.uint64(0),
        (idx >> 32).astype(np.uint64) & mask, np.uint64(0), idx.astype(np.uint64) & mask, np.uint64(0), np.uint64(0),
    ]
    a = np.zeros(np.broadcast(idx, np.asarray(stream)).shape, dtype=np.uint64)
    for w in words:
        y = a ^ w
        a = (((y >> s16) ^ y) * mul) & mask
    return (a >> s16) ^ a


def uniform(seed: int, stream, index) -> np.ndarray:
    """NumPy form; ``stream`` and ``index`` may be arrays."""
    h1, h2 = (_hash_np(seed, half, stream, index) for half in (0, 1))
    v = (h1 << np.uint64(20)) + (h2 >> np.uint64(12))
    return (v.astype(np.float64) + 0.5) / float(1 << 52)


def _words_sql(seed: int, half: int, stream, index: str, high: str) -> list[str]:
    words = [str(_key(seed, half)), "0", str(stream), "0", f"({high}) & {_MASK}", "0", f"({index}) & {_MASK}", "0", "0"]
    return [f"CAST({w} AS BIGINT)" for w in words]


def uniform_expr(seed: int, stream, index: str) -> str:
    """Spark SQL text; ``stream`` a number or column, ``index`` a BIGINT one."""

    def h(half):
        words = ", ".join(_words_sql(seed, half, stream, index, f"shiftright({index}, 32)"))
        step = f"(a, v) -> ((shiftright(a ^ v, 16) ^ (a ^ v)) * {_MUL}L) & {_MASK}L"
        return f"aggregate(array({words}), 0L, {step}, a -> shiftright(a, 16) ^ a)"

    return f"((CAST({h(0)} * 1048576L + shiftright({h(1)}, 12) AS DOUBLE) + 0.5D) / {float(1 << 52)!r}D)"


def uniform_col(seed: int, stream, index: str) -> Column:
    return F.expr(uniform_expr(seed, stream, index))


def uniform_sql(seed: int, stream, index: str) -> str:
    """DuckDB text of the same number."""

    def h(half):
        words = ", ".join(_words_sql(seed, half, stream, index, f"{index} >> 32"))
        return f"list_reduce([0, {words}], lambda a, v: (xor(xor(a, v) >> 16, xor(a, v)) * {_MUL}) & {_MASK})"

    def fin(x):
        return f"list_reduce([{x}, 0], lambda a, v: xor(a >> 16, a))"

    return f"((CAST({fin(h(0))} * 1048576 + ({fin(h(1))} >> 12) AS DOUBLE) + 0.5) / {float(1 << 52)!r})"


def gaussian(seed: int, stream, index) -> np.ndarray:
    """Standard normal numbers (Box-Muller on the streams 2s and 2s + 1)."""
    s = 2 * np.asarray(stream, dtype=np.int64)
    return np.sqrt(-2.0 * np.log(uniform(seed, s, index))) * np.cos(2.0 * np.pi * uniform(seed, s + 1, index))


def gaussian_sql(seed: int, stream: int, index: str) -> str:
    return f"(sqrt(-2.0 * ln({uniform_sql(seed, 2 * stream, index)})) * cos(2.0 * pi() * {uniform_sql(seed, 2 * stream + 1, index)}))"
