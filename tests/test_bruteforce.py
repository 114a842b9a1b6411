"""The order-dependent outlier rule (no SQL form) against a plain-Python
loop written from the rule's description, on the events fixture."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tiltframe.plans.common import DELTA_DAYS, EV_Q, EV_SPLIT, M_LAST, T_FACTOR
from tiltframe.functions.probit import probit_py


def _d2(a, b):
    return sum((x - y) * (x - y) for x, y in zip(a, b))


def _rmsd(n, s1, s2):
    return math.sqrt(max(sum(s2) / n - sum(v * v for v in s1) / (n * n), 0.0))


def brute(points, q, split, t, m, delta):
    """points: (id, [x0, x1], day). Returns q slots as dicts."""
    seeds = [p[1] for p in sorted(points)[:q]]
    slots = [dict(ids=[i], n=0, s1=[0.0, 0.0], s2=[0.0, 0.0], t1=0, t2=0, c=list(seeds[i]), r=0.0) for i in range(q)]
    # state of days < split, all points inside
    for pid, x, day in points:
        if day >= split:
            continue
        j = min(range(q), key=lambda k: (_d2(x, seeds[k]), k))
        s = slots[j]
        s["n"] += 1
        s["s1"] = [a + b for a, b in zip(s["s1"], x)]
        s["s2"] = [a + b * b for a, b in zip(s["s2"], x)]
        s["t1"] += day
        s["t2"] += day * day

    def refresh():
        for s in slots:
            if s["n"] > 0:
                s["c"] = [v / s["n"] for v in s["s1"]]
            if s["n"] > 1:
                s["r"] = _rmsd(s["n"], s["s1"], s["s2"])
        for s in slots:
            if s["n"] == 1:
                ds = [_d2(s["c"], o["c"]) for o in slots]
                ds = [d for d in ds if d != 0.0]
                s["r"] = math.sqrt(min(ds)) if ds else math.inf

    refresh()
    # later days: outliers against the refreshed state, in (day, id) order
    outl = []
    for pid, x, day in points:
        if day < split:
            continue
        j = min(range(q), key=lambda k: (_d2(x, slots[k]["c"]), k))
        if not math.sqrt(_d2(x, slots[j]["c"])) <= t * slots[j]["r"]:
            outl.append((day, pid, x))
    outl.sort()

    def stamp(s):
        n = s["n"]
        mu = s["t1"] / n if n > 0 else 0.0
        if n < 2 * m:
            return mu
        sd = math.sqrt(max(s["t2"] / n - mu * mu, 0.0))
        return mu + sd * probit_py(1 - m / (2.0 * n))

    stale = [i for i, s in enumerate(slots) if stamp(s) < split - delta or s["n"] == 0]
    keep = [i for i in range(q) if i not in stale]
    if len(keep) < 2:
        keep = list(range(q))
    next_id = q
    new = []
    used = 0
    for day, pid, x in outl:
        best, bi = math.inf, None
        for i in new:
            d = _d2(x, [v / slots[i]["n"] for v in slots[i]["s1"]])
            if d < best:
                best, bi = d, i
        if bi is not None and math.sqrt(best) <= t * slots[bi]["r"]:
            s = slots[bi]
            s["n"] += 1
            s["s1"] = [a + b for a, b in zip(s["s1"], x)]
            s["s2"] = [a + b * b for a, b in zip(s["s2"], x)]
            s["t1"] += day
            s["t2"] += day * day
            s["c"] = [v / s["n"] for v in s["s1"]]
            s["r"] = _rmsd(s["n"], s["s1"], s["s2"])
            continue
        if used < len(stale):
            target = stale[used]
            used += 1
        else:
            best, pa = math.inf, None
            for ia in range(len(keep)):
                for ib in range(ia + 1, len(keep)):
                    d = _d2(slots[keep[ia]]["c"], slots[keep[ib]]["c"])
                    if d < best:
                        best, pa = d, (keep[ia], keep[ib])
            a, b = pa
            A, B = slots[a], slots[b]
            A["n"] += B["n"]
            A["s1"] = [u + v for u, v in zip(A["s1"], B["s1"])]
            A["s2"] = [u + v for u, v in zip(A["s2"], B["s2"])]
            A["t1"] += B["t1"]
            A["t2"] += B["t2"]
            A["ids"] = A["ids"] + B["ids"]
            A["c"] = [v / A["n"] for v in A["s1"]]
            A["r"] = _rmsd(A["n"], A["s1"], A["s2"])
            target = b
        s = slots[target]
        s.update(ids=[next_id], n=1, s1=list(x), s2=[v * v for v in x], t1=day, t2=day * day, c=list(x))
        next_id += 1
        ds = [_d2(s["c"], o["c"]) for o in slots]
        ds = [d for d in ds if d != 0.0]
        s["r"] = math.sqrt(min(ds)) if ds else math.inf
        new.append(target)
    refresh()
    return slots


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_absorb_outliers_against_brute_force(spark, sf):
    from tiltframe.plans.common import ev_points

    pts = [(r["id"], list(r["x"]), r["tick"]) for r in ev_points(spark, sf).collect()]
    want = brute(pts, EV_Q, EV_SPLIT, T_FACTOR, M_LAST, DELTA_DAYS)
    got = {r["slot"]: r for r in E.queries()["absorb_outliers"](spark, sf).collect()}
    assert len(got) == EV_Q
    for i, s in enumerate(want):
        g = got[i]
        assert g["ids"] == ",".join(map(str, s["ids"])), i
        assert g["n"] == s["n"] and g["cf1t"] == s["t1"] and g["cf2t"] == s["t2"], i
        assert g["cf1x0"] == pytest.approx(round(s["s1"][0], 4), abs=1e-3)
        assert g["cf2x1"] == pytest.approx(round(s["s2"][1], 4), abs=1e-3)


@pytest.mark.parametrize("sf,limit", [(SF_SMALL, 2), ("/root/testdata/sf0.01", 50)])
def test_absorb_outliers_in_chunks(spark, monkeypatch, sf, limit):
    """More outliers than a chunk holds: the same rule, the same slots."""
    import functools

    import tiltframe.plans.queries as pq

    whole = [tuple(r) for r in E.queries()["absorb_outliers"](spark, sf).orderBy("slot").collect()]
    monkeypatch.setattr(pq, "OnlineParams", functools.partial(pq.OnlineParams, max_candidates=limit))
    assert pq._ev_batch_outliers(spark, sf)[1].count() > limit
    assert [tuple(r) for r in E.queries()["absorb_outliers"](spark, sf).orderBy("slot").collect()] == whole
    test_absorb_outliers_against_brute_force(spark, sf)


def test_online_run_in_chunks(spark):
    from tiltframe.params import OnlineParams
    from tiltframe.plans.common import ev_points
    from tiltframe.streaming.online import OnlineClusterer

    states = []
    for limit in (2, 2000):
        m = OnlineClusterer(spark, OnlineParams(q=6, dim=2, m=20, delta=2, max_candidates=limit))
        for t in range(4):
            m.step(ev_points(spark, SF_SMALL).where(f"tick = {t}"), t)
        states.append([tuple(r) for r in m.state().select("slot", "ids", "n", "cf1x", "cf1t", "cf2t").orderBy("slot").collect()])
    assert states[0] == states[1]


def brute_online(points, q, dim, min_init, t, m, delta, seed, snaps=None):
    """Plain-Python run of the online phase, one batch per day; ``snaps``
    (a dict) receives a copy of the state after each non-empty batch once
    started, keyed by the clock after the batch."""
    from tiltframe.operators.kmeans import random_gaussian_model

    C = [list(map(float, row)) for row in random_gaussian_model(q, dim, seed)[1]]
    W = [0.0] * q
    days = sorted({d for _, _, d in points})
    by_day = {d: sorted((pid, x) for pid, x, dd in points if dd == d) for d in days}
    slots, total, next_id = None, 0, q

    def nearest(x, cents):
        return min(range(len(cents)), key=lambda k: (_d2(x, cents[k]), k))

    def refresh():
        for s in slots:
            if s["n"] > 0:
                s["c"] = [v / s["n"] for v in s["s1"]]
            if s["n"] > 1:
                s["r"] = _rmsd(s["n"], s["s1"], s["s2"])
        for s in slots:
            if s["n"] == 1:
                ds = [d for d in (_d2(s["c"], o["c"]) for o in slots) if d != 0.0]
                s["r"] = math.sqrt(min(ds)) if ds else math.inf

    def add(s, x, day):
        s["n"] += 1
        s["s1"] = [a + b for a, b in zip(s["s1"], x)]
        s["s2"] = [a + b * b for a, b in zip(s["s2"], x)]
        s["t1"] += day
        s["t2"] += day * day

    def stamp(s):
        n = s["n"]
        mu = s["t1"] / n if n > 0 else 0.0
        if n < 2 * m:
            return mu
        sd = math.sqrt(max(s["t2"] / n - mu * mu, 0.0))
        return mu + sd * probit_py(1 - m / (2.0 * n))

    for day in range(max(days) + 1):
        batch = by_day.get(day, [])
        if not batch:
            continue
        if slots is None:
            # streaming k-means update (decay 1, per batch), then maybe start
            stats = {}
            for _, x in batch:
                j = nearest(x, C)
                c, sx = stats.get(j, (0, [0.0] * dim))
                stats[j] = (c + 1, [a + b for a, b in zip(sx, x)])
            for j, (cnt, sx) in stats.items():
                w1 = W[j] + cnt
                lam = cnt / max(w1, 1e-16)
                W[j] = w1
                C[j] = [(1.0 - lam) * c + (lam / cnt) * s_ for c, s_ in zip(C[j], sx)]
            big = max(range(q), key=lambda k: (W[k], -k))
            small = min(range(q), key=lambda k: (W[k], k))
            if W[small] < 1e-8 * W[big]:
                mean = (W[big] + W[small]) / 2.0
                W[big] = W[small] = mean
                cl = list(C[big])
                C[big] = [v + 1e-14 * max(abs(v), 1.0) for v in cl]
                C[small] = [v - 1e-14 * max(abs(v), 1.0) for v in cl]
            if total >= min_init:
                slots = [dict(ids=[i], n=0, s1=[0.0] * dim, s2=[0.0] * dim, t1=0, t2=0, c=list(C[i]), r=0.0) for i in range(q)]
                for _, x in batch:
                    add(slots[nearest(x, [list(c) for c in C])], x, day)
                refresh()
                if snaps is not None:
                    snaps[day + 1] = [dict(s, ids=list(s["ids"]), s1=list(s["s1"]), s2=list(s["s2"])) for s in slots]
            total += len(batch)
            continue
        view = [(list(s["c"]), s["r"]) for s in slots]
        outl = []
        for pid, x in batch:
            j = nearest(x, [v[0] for v in view])
            if math.sqrt(_d2(x, view[j][0])) <= t * view[j][1]:
                add(slots[j], x, day)
            else:
                outl.append((pid, x))
        if outl:
            stale = [i for i, s in enumerate(slots) if stamp(s) < day - delta or s["n"] == 0]
            keep = [i for i in range(q) if i not in stale]
            if len(keep) < 2:
                keep = list(range(q))
            new, used = [], 0
            for pid, x in outl:
                best, bi = math.inf, None
                for i in new:
                    d = _d2(x, [v / slots[i]["n"] for v in slots[i]["s1"]])
                    if d < best:
                        best, bi = d, i
                if bi is not None and math.sqrt(best) <= t * slots[bi]["r"]:
                    s = slots[bi]
                    add(s, x, day)
                    s["c"] = [v / s["n"] for v in s["s1"]]
                    s["r"] = _rmsd(s["n"], s["s1"], s["s2"])
                    continue
                if used < len(stale):
                    target = stale[used]
                    used += 1
                else:
                    best, pa = math.inf, None
                    for ia in range(len(keep)):
                        for ib in range(ia + 1, len(keep)):
                            d = _d2(slots[keep[ia]]["c"], slots[keep[ib]]["c"])
                            if d < best:
                                best, pa = d, (keep[ia], keep[ib])
                    a, b = pa
                    A, B = slots[a], slots[b]
                    for key in ("n", "t1", "t2"):
                        A[key] += B[key]
                    A["s1"] = [u + v for u, v in zip(A["s1"], B["s1"])]
                    A["s2"] = [u + v for u, v in zip(A["s2"], B["s2"])]
                    A["ids"] = A["ids"] + B["ids"]
                    A["c"] = [v / A["n"] for v in A["s1"]]
                    A["r"] = _rmsd(A["n"], A["s1"], A["s2"])
                    target = b
                s = slots[target]
                s.update(ids=[next_id], n=1, s1=list(x), s2=[v * v for v in x], t1=day, t2=day * day, c=list(x))
                next_id += 1
                ds = [d for d in (_d2(s["c"], o["c"]) for o in slots) if d != 0.0]
                s["r"] = math.sqrt(min(ds)) if ds else math.inf
                new.append(target)
        refresh()
        total += len(batch)
        if snaps is not None:
            snaps[day + 1] = [dict(s, ids=list(s["ids"]), s1=list(s["s1"]), s2=list(s["s2"])) for s in slots]
    return slots


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_online_run_against_brute_force(spark, sf):
    from tiltframe.plans.common import ev_points
    from tiltframe.plans.queries import MIN_INIT

    pts = [(r["id"], list(r["x"]), r["tick"]) for r in ev_points(spark, sf).collect()]
    want = brute_online(pts, EV_Q, 2, MIN_INIT, T_FACTOR, M_LAST, DELTA_DAYS, 42)
    got = {r["slot"]: r for r in E.queries()["online_run"](spark, sf).collect()}
    for i, s in enumerate(want):
        g = got[i]
        assert g["ids"] == ",".join(map(str, s["ids"])), i
        assert (g["n"], g["cf1t"], g["cf2t"]) == (s["n"], s["t1"], s["t2"]), i
        assert g["cf1x0"] == pytest.approx(round(s["s1"][0], 4), abs=1e-3)


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_init_streaming_kmeans_against_brute_force(spark, sf):
    from tiltframe.plans.common import ev_points
    from tiltframe.plans.queries import EV_HALF

    pts = [(r["id"], list(r["x"]), int(r["tick"] >= EV_HALF)) for r in ev_points(spark, sf).collect()]
    want = brute_online(pts, EV_Q, 2, 100, T_FACTOR, M_LAST, DELTA_DAYS, 42)
    got = {r["slot"]: r for r in E.queries()["init_streaming_kmeans"](spark, sf).collect()}
    assert len(got) == EV_Q and sum(s["n"] for s in want) == sum(1 for p in pts if p[2])
    for i, s in enumerate(want):
        assert got[i]["ids"] == ",".join(map(str, s["ids"])) and got[i]["n"] == s["n"], i


def test_init_kmeans_folds_every_point_into_its_nearest_center(spark):
    from pyspark.sql import functions as F
    from tiltframe.plans.common import ev_points

    got = E.queries()["init_kmeans"](spark, SF_SMALL)
    raw = ev_points(spark, SF_SMALL).agg(F.count(F.lit(1)), F.sum(F.col("x")[0]), F.sum(F.col("x")[1])).first()
    mine = got.agg(F.sum("n"), F.sum("cf1x0"), F.sum("cf1x1")).first()
    assert mine[0] == raw[0] and mine[1] == pytest.approx(raw[1], abs=1e-2) and mine[2] == pytest.approx(raw[2], abs=1e-2)


def _live(t, now, alpha=2, l=2):
    order = 0
    while t % alpha ** (order + 1) == 0:
        order += 1
    return 1 <= t <= now and t + (alpha**l + 1) * alpha ** (order + 1) > now


def _lloyd(X, w, C, iters, tol):
    C = [list(c) for c in C]
    for _ in range(iters):
        idx = [min(range(len(C)), key=lambda k: (_d2(x, C[k]), k)) for x in X]
        moved = False
        for j in range(len(C)):
            sw = sum(w[i] for i in range(len(X)) if idx[i] == j)
            if sw > 0:
                nc = [sum(w[i] * X[i][d] for i in range(len(X)) if idx[i] == j) / sw for d in range(len(C[j]))]
                if _d2(nc, C[j]) > tol * tol:
                    moved = True
                C[j] = nc
        if not moved:
            break
    idx = [min(range(len(C)), key=lambda k: (_d2(x, C[k]), k)) for x in X]
    return C, [sum(w[i] for i in range(len(X)) if idx[i] == j) for j in range(len(C))]


def _macro(snaps, now, tc, h, k=3):
    """Macro-clusters (weight, center) of a request against the snapshots that
    are live at ``now`` (None: all given); None without a snapshot that early."""
    live = sorted(t for t in snaps if now is None or _live(t, now))
    le = [t for t in live if t <= tc]
    if not le:
        return None
    t1 = le[-1]
    le2 = [t for t in live if t <= t1 - h]
    t2 = le2[-1] if le2 else live[0]
    mcs = []
    for s in snaps[t1]:
        rel = [o for o in snaps[t2] if set(o["ids"]) & set(s["ids"])]
        n, s1 = s["n"], list(s["s1"])
        if rel and t1 - h >= t2:
            n -= sum(o["n"] for o in rel)
            s1 = [a - sum(o["s1"][d] for o in rel) for d, a in enumerate(s1)]
        if n > 0:
            mcs.append((n, [v / n for v in s1]))
    w = [float(n) for n, _ in mcs]
    order = sorted(range(len(mcs)), key=lambda i: (-w[i], i))[:k]
    C, wt = _lloyd([c for _, c in mcs], w, [mcs[i][1] for i in order], 20, 1e-4)
    return sorted((round(x, 4), *c) for x, c in zip(wt, C))


def _same_macro(got, want):
    assert sorted(got) == sorted(want)
    for k, rows in got.items():
        rows = sorted(rows)
        assert [r[0] for r in rows] == [w[0] for w in want[k]], k
        for a, b in zip(rows, want[k]):
            assert a[1] == pytest.approx(b[1], abs=1e-3) and a[2] == pytest.approx(b[2], abs=1e-3), k


def test_online_horizon_against_brute_force(spark):
    from tiltframe.plans.common import ev_points
    from tiltframe.plans.queries import MIN_INIT, REQUESTS

    pts = [(r["id"], list(r["x"]), r["tick"]) for r in ev_points(spark, SF_SMALL).collect()]
    snaps = {}
    brute_online(pts, EV_Q, 2, MIN_INIT, T_FACTOR, M_LAST, DELTA_DAYS, 42, snaps)
    want = {(tc, h): _macro(snaps, max(snaps), tc, h) for tc, h in REQUESTS}
    got = {}
    for r in E.queries()["online_horizon"](spark, SF_SMALL).collect():
        got.setdefault((r["tc"], r["h"]), []).append((r["weight"], r["c0"], r["c1"]))
    _same_macro(got, {k: v for k, v in want.items() if v is not None})


def test_milestone_centers_against_brute_force(spark):
    from tiltframe.plans.common import ev_points
    from tiltframe.plans.queries import MARK_BAND, MARK_HORIZON, MIN_INIT

    pts = [(r["id"], list(r["x"]), r["tick"]) for r in ev_points(spark, SF_SMALL).collect()]
    total = len(pts)
    start = min(MIN_INIT, total // 10)
    snaps = {}
    brute_online(pts, EV_Q, 2, start, T_FACTOR, M_LAST, DELTA_DAYS, 42, snaps)
    band, want, run = total // MARK_BAND + 1, {}, 0
    for day in range(max(d for *_, d in pts) + 1):
        run += sum(1 for *_, d in pts if d == day)
        for mark in (total // 4, total * 2 // 4, total * 3 // 4):
            if mark - band < run <= mark + band and day + 1 in snaps:
                # at that moment no later snapshot is there, and those that leave with this one still are
                kept = {t: s for t, s in snaps.items() if t == day + 1 or _live(t, day)}
                want[mark, day + 1, run] = _macro(kept, None, day + 1, MARK_HORIZON)
    got = {}
    for r in E.queries()["milestone_centers"](spark, SF_SMALL).collect():
        got.setdefault((r["mark"], r["tc"], r["n_total"]), []).append((r["weight"], r["c0"], r["c1"]))
    assert len({m for m, *_ in want}) == 3
    _same_macro(got, want)
