"""Vectorised text kernels shared by the operators (NumPy inside tasks).

Texts arrive as Arrow string arrays; everything works on their UTF-8 bytes.
``blocks`` cuts an array into runs of documents of bounded size (a longer
document is a block of its own), so the working memory of a task does not
grow with the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: The ASCII white space that separates words and is stripped from lines.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_CHARS = "".join(map(chr, SPACE_BYTES))

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# odd multiplier and its inverse mod 2^64 (rolling polynomial over bytes)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, size=256, dtype=np.uint64) | U64(1)

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift / multiply) over an unsigned array."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 entries) of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) and not pa.types.is_large_binary(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return b, o


def blocks(arr: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets from 0) of runs of documents holding at
    most ``max_bytes`` bytes, or of one longer document."""
    if len(arr) == 0:
        return
    data, off = utf8_buffers(arr)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words (maximal runs without ASCII white space, inside one document) of
    a block: (64-bit hash per word, word offsets per document). A-Z count as
    a-z when ``lower``."""
    n, docs = len(data), len(off) - 1
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(docs + 1, dtype=np.int64)
    solid = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)  # a document starts (or the block ends) here
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    pw, inv = _power_table(n + 1)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[data] if lower else data] * pw[:n], out=acc[1:])
    h = mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off).astype(np.int64)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (across documents too:
    the caller keeps those that stay inside one)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - k + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        out = out * U64(_BASE) + h[j : j + m]
    return mix(out + U64(k))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per document: its sorted distinct ``k``-word shingles (with fewer words
    the whole sequence as one shingle; without words none)."""
    h, wo = words(data, off)
    g = ngrams(h, k)
    for d in range(len(off) - 1):
        a, b = int(wo[d]), int(wo[d + 1])
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield ngrams(h[a:b], b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)
