"""Exact nearest-center search over many centers (ON6, ON11).

``CenterSearch`` is built once per task from the centers every task holds
(bounded by parameters). Up to ``MIN_INDEXED`` centers it is one matrix product
per batch (``nearest``). Beyond, the centers lie in balls: halved at the
median of their widest dimension until a ball has at most ``LEAF`` members. The
triangle inequality bounds the distance to a ball's members from below
(distance to its middle less its radius); only balls whose bound does not
exceed the best distance found so far are compared, by one product per ball.

The result equals the plain scan in slot order bit for bit, ties included:
bounds give way by more than the products' rounding, and a row whose runner-up
lies within that rounding is compared again by plain differences, over the
balls in question, equal distances going to the lowest slot.
"""

from __future__ import annotations

import numpy as np

MIN_INDEXED = 512
LEAF = 64
#: Entries of the largest matrix (rows x balls) held at a time.
CELLS = 1 << 22
MAX_ROWS = 16_384


def _nearest_scan(X: np.ndarray, C: np.ndarray):
    """Exact scan: centers in slot order with a strict minimum (ties go to
    the lowest slot). O(rows x dim) memory per center."""
    n = X.shape[0]
    best = np.full(n, np.inf)
    idx = np.zeros(n, dtype=np.int64)
    for j in range(C.shape[0]):
        diff = X - C[j]
        d2 = np.einsum("ij,ij->i", diff, diff)
        better = d2 < best
        best[better] = d2[better]
        idx[better] = j
    return idx, best


def nearest(X: np.ndarray, C: np.ndarray):
    """Index of the nearest center per row and the exact squared distance.

    Candidates come from one matrix product (|x|^2 - 2 x.c + |c|^2, BLAS);
    a row whose runner-up lies within the rounding bound of that form is
    re-scanned exactly, so the result equals the exact strict-minimum scan
    (ties to the lowest slot) at matrix-product speed.
    """
    n, d = X.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    xx = np.einsum("ij,ij->i", X, X)
    cc = np.einsum("ij,ij->i", C, C)
    A = xx[:, None] - 2.0 * (X @ C.T) + cc[None, :]
    idx = np.argmin(A, axis=1)
    amin = A[np.arange(n), idx]
    tol = 16.0 * (d + 2) * np.finfo(np.float64).eps * (xx + cc.max())
    close = (A <= (amin + 2.0 * tol)[:, None]).sum(axis=1) > 1
    if close.any():
        idx[close], _ = _nearest_scan(X[close], C)
    diff = X - C[idx]
    return idx, np.einsum("ij,ij->i", diff, diff)


def _balls(C: np.ndarray) -> list[np.ndarray]:
    out, open_ = [], [np.arange(len(C))]
    while open_:
        part = open_.pop()
        if len(part) <= LEAF:
            out.append(np.sort(part))
            continue
        wide = int(np.argmax(np.ptp(C[part], axis=0)))
        part = part[np.argsort(C[part, wide], kind="stable")]
        half = len(part) // 2
        open_ += [part[half:], part[:half]]
    return out


def _norm2(X: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", X, X)


class CenterSearch:
    def __init__(self, C: np.ndarray):
        self.C = np.ascontiguousarray(C, dtype=np.float64)
        self.indexed = len(self.C) > MIN_INDEXED
        if self.indexed:
            self.members = _balls(self.C)
            self.parts = [self.C[m] for m in self.members]
            self.norms = [_norm2(p) for p in self.parts]
            self.middles = np.array([p.mean(axis=0) for p in self.parts])
            # inflated: the radius itself is rounded
            self.radii = np.array([np.sqrt(_norm2(p - c).max()) for p, c in zip(self.parts, self.middles)]) * (1.0 + 1e-9)
            self.longest = max(float(n.max()) for n in self.norms)
            self.scanned = 0  # pairs compared, for measurements

    def __call__(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest center per row and the squared distance."""
        if not self.indexed:
            return nearest(X, self.C)
        idx = np.zeros(len(X), dtype=np.int64)
        step = max(1, min(MAX_ROWS, CELLS // len(self.members)))
        for a in range(0, len(X), step):
            idx[a : a + step] = self._block(X[a : a + step])
        diff = X - self.C[idx]
        return idx, _norm2(diff)

    def _block(self, X: np.ndarray) -> np.ndarray:
        n, d = X.shape
        xx = _norm2(X)
        tol = 16.0 * (d + 2) * np.finfo(np.float64).eps * (xx + self.longest)
        to_middle = _norm2(self.middles)[:, None] - 2.0 * (self.middles @ X.T) + xx
        low = np.sqrt(np.maximum(to_middle - tol, 0.0)) - self.radii[:, None]
        low = np.where(low < 0.0, 0.0, low * low)
        best, second, idx = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, dtype=np.int64)

        def compare(j: int, rows: np.ndarray) -> None:
            A = xx[rows, None] - 2.0 * (X[rows] @ self.parts[j].T) + self.norms[j]
            self.scanned += A.size
            at = np.arange(len(rows))
            k = A.argmin(axis=1)
            least = A[at, k]
            A[at, k] = np.inf
            before = best[rows]
            second[rows] = np.minimum(np.minimum(second[rows], A.min(axis=1)), np.maximum(before, least))
            better = least < before
            best[rows[better]], idx[rows[better]] = least[better], self.members[j][k[better]]

        first = to_middle.argmin(axis=0)
        order = np.argsort(first, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            compare(int(first[rows[0]]), rows)
        for j in range(len(self.members)):
            rows = np.flatnonzero(~(low[j] > best + 4.0 * tol) & (first != j))
            if rows.size:
                compare(j, rows)
        close = np.flatnonzero(second <= best + 2.0 * tol)
        if close.size:
            idx[close] = self._scan(X[close], low[:, close], (best + 4.0 * tol)[close])
        return idx

    def _scan(self, X: np.ndarray, low: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Plain differences over the balls not beyond ``most``."""
        best, idx = np.full(len(X), np.inf), np.zeros(len(X), dtype=np.int64)
        for j, members in enumerate(self.members):
            rows = np.flatnonzero(low[j] <= most)
            if not rows.size:
                continue
            mine = X[rows]
            for c in members.tolist():
                d2 = _norm2(mine - self.C[c])
                better = (d2 < best[rows]) | ((d2 == best[rows]) & (c < idx[rows]))
                best[rows[better]], idx[rows[better]] = d2[better], c
        return idx

    def nearest_other(self, i: int) -> float:
        """Distance of center ``i`` to the nearest center that is not at
        distance 0; infinity without one."""
        x = self.C[i]
        if not self.indexed:
            d2 = _norm2(self.C - x)
            return float(np.sqrt(np.where(d2 == 0.0, np.inf, d2).min()))
        away = np.sqrt(_norm2(self.middles - x))
        low = away - self.radii - 1e-9 * (away + self.radii)
        best = np.inf
        for j in np.argsort(low, kind="stable").tolist():
            if low[j] > best:
                break
            d2 = _norm2(self.parts[j] - x)
            best = min(best, float(np.sqrt(np.where(d2 == 0.0, np.inf, d2).min())))
        return best
