"""Hand-worked golden cases (FIXTURES.md section 4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltframe.functions.probit import probit_py
from tiltframe.operators import snapshots as sn
from tiltframe.operators.features import cf_aggregate, refresh
from tiltframe.operators.maintain import ClosestPair, OutlierRule, refresh_arrays
from tiltframe.operators.recency import relevance_stamp
from tiltframe.params import SnapshotParams


def test_cf_and_rmsd(spark):
    pts = spark.createDataFrame([(0, [1.0, 2.0], 4), (0, [3.0, 4.0], 4), (0, [5.0, 0.0], 4)], "slot int, x array<double>, tick long")
    cf = cf_aggregate(pts, 2, "x", "tick").first()
    assert cf["n"] == 3 and cf["cf1x"] == [9.0, 6.0] and cf["cf2x"] == [35.0, 20.0]
    assert cf["cf1t"] == 12 and cf["cf2t"] == 48
    st = spark.createDataFrame(
        [(0, [0], 3, [9.0, 6.0], [35.0, 20.0], 12, 48, [0.0, 0.0], 0.0), (1, [1], 0, [0.0, 0.0], [0.0, 0.0], 0, 0, [100.0, 100.0], 0.0)],
        "slot int, ids array<bigint>, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, centroid array<double>, rmsd double",
    )
    r = {row["slot"]: row for row in refresh(st).collect()}
    assert r[0]["centroid"] == [3.0, 2.0]
    assert r[0]["rmsd"] == pytest.approx(2.309401076758503, abs=1e-12)
    assert r[1]["centroid"] == [100.0, 100.0] and r[1]["rmsd"] == 0.0


@pytest.mark.parametrize(
    "n,cf1t,cf2t,m,stamp",
    [
        (4, 40, 420, 10, 10.0),
        (10, 50, 330, 2, 8.624775209747295),
        (100, 5000, 260000, 20, 62.815515655446),
        (1000, 50000, 2600000, 20, 73.2634787404084),
    ],
)
def test_relevance_stamp(spark, n, cf1t, cf2t, m, stamp):
    df = spark.createDataFrame([(n, cf1t, cf2t)], "n bigint, cf1t bigint, cf2t bigint")
    got = df.select(relevance_stamp("n", "cf1t", "cf2t", m).alias("s")).first()["s"]
    assert got == pytest.approx(stamp, abs=1e-6)


def test_probit_accuracy():
    # compare with a bisection on the error function (pure python)
    for p in [1e-4, 0.01, 0.02425, 0.1, 0.5, 0.9, 0.97575, 0.999]:
        lo, hi = -10.0, 10.0
        for _ in range(200):
            mid = (lo + hi) / 2
            if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
                lo = mid
            else:
                hi = mid
        assert probit_py(p) == pytest.approx(lo, abs=1e-8)


@pytest.mark.parametrize(
    "alpha,l,T,live",
    [
        (2, 2, 40, [4, 8, 12, 16, 20, 22, 24, 26, 28, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40]),
        (2, 1, 20, [4, 8, 10, 12, 14, 15, 16, 17, 18, 19, 20]),
        (3, 1, 60, [9, 18, 27, 30, 33, 36, 39, 42, 45, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60]),
    ],
)
def test_live_snapshots(spark, alpha, l, T, live):
    s = sn.schedule(spark, T, SnapshotParams(alpha, l)).where("live").orderBy("tick")
    assert [r["tick"] for r in s.collect()] == live


def test_step_by_step_expiry_matches_closed_form(spark, tmp_path):
    p = SnapshotParams(2, 2)
    path = str(tmp_path / "snaps")
    st = spark.createDataFrame([(0, [0], 1, [1.0], [1.0], 0, 0, [1.0], 0.0)], "slot int, ids array<bigint>, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, centroid array<double>, rmsd double")
    for tc in range(1, 41):
        sn.save_snapshot(spark, st, path, tc, p)
    kept = sorted(int(r["tick"]) for r in sn.live_ticks(sn.read_snapshots(spark, path)).collect())
    assert kept == [4, 8, 12, 16, 20, 22, 24, 26, 28, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40]


def test_snapshot_pairs(spark):
    ticks = spark.createDataFrame([(t,) for t in [4, 8, 12, 16, 20, 22, 24, 26, 28, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40]], "tick long")
    req = [(40, 1), (40, 5), (40, 16), (41, 3), (40, 39), (40, 100), (7, 2), (0, 1)]
    want = {(40, 1): (40, 39), (40, 5): (40, 35), (40, 16): (40, 24), (41, 3): (40, 37), (40, 39): (40, 4),
            (40, 100): (40, 4), (7, 2): (4, 4), (0, 1): (-1, -1)}
    got = sn.snapshot_pairs(spark.createDataFrame(req, "tc long, h long"), ticks).collect()
    assert {(r["tc"], r["h"]): (r["t1"], r["t2"]) for r in got} == want


def test_horizon_subtraction(spark):
    schema = "slot int, ids array<bigint>, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint"
    s1 = spark.createDataFrame([(0, [1, 2], 10, [50.0], [300.0], 330, 11042), (1, [7], 3, [30.0], [302.0], 117, 4563)], schema)
    s2 = spark.createDataFrame(
        [(0, [1], 4, [16.0], [70.0], 120, 3610), (1, [2], 2, [14.0], [100.0], 60, 1802), (2, [5], 9, [90.0], [950.0], 270, 8200)], schema
    )
    out = {r["slot"]: r for r in sn.horizon_subtract(s1, s2, 5, 40, 35).collect()}
    assert out[0]["ids"] == [] and out[0]["n"] == 4 and out[0]["cf1x"] == [20.0] and out[0]["cf2x"] == [130.0]
    assert out[0]["cf1t"] == 150 and out[0]["cf2t"] == 5630
    assert out[1]["ids"] == [7] and out[1]["n"] == 3 and out[1]["cf1x"] == [30.0]
    assert all(r["horizon_exact"] for r in out.values())
    # t1 - h < t2: kept whole
    whole = {r["slot"]: r for r in sn.horizon_subtract(s1, s2, 39, 40, 4).collect()}
    assert whole[0]["n"] == 10 and not whole[0]["horizon_exact"]


def _outlier_state():
    return {
        "ids": [[0], [1], [2]],
        "n": np.array([0, 2, 2]),
        "cf1x": np.array([[0.0], [20.0], [22.0]]),
        "cf2x": np.array([[0.0], [202.0], [244.0]]),
        "cf1t": np.array([0, 0, 0]),
        "cf2t": np.array([0, 0, 0]),
        "centroid": np.array([[0.0], [10.0], [11.0]]),
        "rmsd": np.array([0.0, 1.0, 1.0]),
        "stale": np.array([True, False, False]),
        "stamp": np.array([0.0, 100.0, 100.0]),
    }


def _run(state, values, recursive=True, t=100):
    rule = OutlierRule(state, 2.0, recursive, 3)
    for v in values:
        rule.add(np.array([float(v)]), t)
    return rule


def test_outlier_rule_recursive():
    st = _outlier_state()
    rule = _run(st, [50, 60, 500])
    assert st["n"].tolist() == [2, 4, 1]
    assert st["cf1x"][0][0] == 110 and st["cf2x"][0][0] == 6100
    assert st["rmsd"][0] == pytest.approx(5.0)
    assert st["ids"][1] == [1, 2] and st["ids"][0] == [3] and st["ids"][2] == [4]
    assert rule.merged == [(2, 1, 1)] and rule.next_id == 5
    assert st["rmsd"][2] == pytest.approx(445.0)
    st = refresh_arrays(st)
    assert st["centroid"][0][0] == 55 and st["centroid"][1][0] == 10.5 and st["centroid"][2][0] == 500
    assert st["rmsd"][1] == pytest.approx(1.118033988749895)
    assert st["rmsd"][2] == pytest.approx(445.0)


def test_outlier_rule_not_recursive():
    st = _outlier_state()
    rule = _run(st, [50, 60, 500], recursive=False)
    # 60 merges slots 1 and 2 and takes slot 2; 500 merges 1 and 2 again and takes slot 2
    assert st["n"].tolist() == [1, 5, 1]
    assert st["cf1x"][1][0] == 20 + 22 + 60
    assert st["cf1x"][2][0] == 500
    # the list of slot 1 is 1, 2, 4: its ends, and the log
    assert st["ids"][1] == [1, 4] and rule.merged == [(2, 1, 1), (4, 1, 2)]


@pytest.mark.parametrize("candidates", [0, 1, 2])
@pytest.mark.parametrize("recursive", [True, False])
def test_no_outlier_is_lost(candidates, recursive):
    """Any number of merge candidates: all points are in the state."""
    r = np.random.default_rng(candidates)
    q, d = 6, 2
    c = r.random((q, d)) * 10
    n = np.array([0, 0, 3, 4, 5, 6])
    stale = np.array([i < q - candidates for i in range(q)])
    st = {"ids": [[i] for i in range(q)], "n": n.copy(), "cf1x": c * n[:, None], "cf2x": c * c * n[:, None], "cf1t": n * 7, "cf2t": n * 49,
          "centroid": c.copy(), "rmsd": np.full(q, 0.5), "stale": stale}
    lost = n[stale].sum()  # what was stale makes room
    rule = OutlierRule(st, 0.3, recursive, q)
    x = r.random((400, d)) * 100
    for i, v in enumerate(x):
        rule.add(v, i % 5)
    assert st["n"].sum() == n.sum() - lost + 400
    assert st["cf1x"].sum(axis=0) == pytest.approx((c * n[:, None])[~stale].sum(axis=0) + x.sum(axis=0))
    assert (st["n"] > 0).all() and max(len(v) for v in st["ids"]) <= 2
    assert len(rule.merged) >= 300 and len({m[0] for m in rule.merged}) == len(rule.merged)


def test_one_slot_takes_every_outlier():
    st = {"ids": [[0]], "n": np.array([2]), "cf1x": np.array([[2.0]]), "cf2x": np.array([[2.0]]), "cf1t": np.array([0]), "cf2t": np.array([0]),
          "centroid": np.array([[1.0]]), "rmsd": np.array([0.0]), "stale": np.array([False])}
    _run(st, range(50, 90))
    assert st["n"].tolist() == [42]


def test_closest_pair_kept_up_to_date():
    r = np.random.default_rng(1)
    for _ in range(60):
        q, d = int(r.integers(2, 30)), int(r.integers(1, 4))
        c = r.integers(0, 6, (q, d)).astype(float)  # many ties
        slots = np.sort(r.choice(q, size=int(r.integers(2, q + 1)), replace=False))
        pairs = ClosestPair(slots, c)
        for _ in range(12):
            want = min((float(((c[a] - c[b]) ** 2).sum()), int(a), int(b)) for i, a in enumerate(slots) for b in slots[i + 1 :])
            assert pairs.best() == want[1:]
            for _ in range(int(r.integers(0, 4))):
                i = int(r.integers(0, q))
                c[i] = r.integers(0, 6, d)
                pairs.moved(i)


def test_expire_all_after_gaps(spark, tmp_path):
    p = SnapshotParams(2, 2)
    path = str(tmp_path / "snaps")
    st = spark.createDataFrame([(0, [0], 1, [1.0], [1.0], 0, 0, [1.0], 0.0)], "slot int, ids array<bigint>, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, centroid array<double>, rmsd double")
    for tc in range(1, 41):
        if tc % 3 == 0:
            continue  # empty ticks: no write, so no expiry at those clocks
        sn.save_snapshot(spark, st, path, tc, p)
    sn.expire_all(spark, path, 40, p)
    kept = sorted(int(r["tick"]) for r in sn.live_ticks(sn.read_snapshots(spark, path)).collect())
    want = [t for t in [4, 8, 12, 16, 20, 22, 24, 26, 28, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40] if t % 3]
    assert kept == want
