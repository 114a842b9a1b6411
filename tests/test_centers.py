"""Search over many centers: same results and ties as the plain scan."""

import numpy as np
import pytest

from tiltframe.operators.centers import MIN_INDEXED, CenterSearch, _nearest_scan
from tiltframe.operators.maintain import _nearest_nonzero, refresh_arrays

R = np.random.default_rng(5)
CASES = {
    "clustered": (R.standard_normal((40, 4))[R.integers(0, 40, 3000)] * 50 + R.standard_normal((3000, 4)), 1500),
    "grid with ties": (R.integers(0, 12, (4000, 3)).astype(float), 1700),
    "unstructured": (R.standard_normal((1200, 64)), 700),
    "far from the origin": (1e8 + R.integers(0, 9, (2000, 2)).astype(float), 900),
    "scales": (R.standard_normal((2000, 3)) * np.array([1e-6, 1.0, 1e6]), 800),
    "one value": (np.ones((900, 2)), 600),
    "one dimension": (R.standard_normal((2500, 1)), 2000),
    "few centers": (R.standard_normal((500, 5)), MIN_INDEXED),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_scan(name):
    X, q = CASES[name]
    C = X[:q].copy()
    C[q // 2] = C[q // 3]  # a center twice: ties go to the lower slot
    search = CenterSearch(C)
    assert search.indexed == (q > MIN_INDEXED)
    for rows in (X, X + 0.25 * R.integers(-2, 3, X.shape), X[:1], X[:0]):
        idx, d2 = search(rows)
        want, least = _nearest_scan(rows, C)
        assert (idx == want).all() and (d2 == least).all()


@pytest.mark.parametrize("name", CASES)
def test_nearest_other(name):
    X, q = CASES[name]
    search = CenterSearch(X[:q])
    for i in range(0, q, 37):
        assert search.nearest_other(i) == _nearest_nonzero(X[i], X[:q])


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_broken_rows_do_not_spread():
    X, q = CASES["clustered"]
    rows = X[:50].copy()
    rows[7], rows[9] = np.nan, np.inf
    idx, d2 = CenterSearch(X[:q])(rows)
    sound = np.setdiff1d(np.arange(50), [7, 9])
    want, least = _nearest_scan(rows[sound], X[:q])
    assert (idx[sound] == want).all() and (d2[sound] == least).all() and not np.isfinite(d2[[7, 9]]).any()


def test_balls_are_left_out():
    X, q = CASES["clustered"]
    search = CenterSearch(X[:q])
    search(X)
    assert search.scanned < 0.25 * len(X) * q


@pytest.mark.parametrize("q", [1, 50, 900])
def test_refresh_of_lone_slots(q):
    r = np.random.default_rng(q)
    n = r.integers(0, 3, q)
    c1 = r.integers(0, 30, (q, 2)).astype(float)
    state = {"n": n, "cf1x": c1, "cf2x": c1 * c1 + 1.0, "centroid": c1.copy(), "rmsd": np.full(q, 7.0)}
    out = refresh_arrays(state)
    for i in np.flatnonzero(n == 1):
        assert out["rmsd"][i] == _nearest_nonzero(out["centroid"][i], out["centroid"])
    assert (out["rmsd"][n == 0] == 7.0).all()
