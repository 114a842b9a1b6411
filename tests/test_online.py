"""Invariants of the online phase: bounded state, conservation of points,
stream = batch, restart = uninterrupted run, partition independence, and
the fused one-task update against the composition of DataFrame operators."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tiltframe.operators.assign import assign, assign_sql, collect_view
from tiltframe.operators.features import cf_aggregate, cf_apply, refresh
from tiltframe.operators.maintain import absorb_outliers, merge_rows, state_rows, update_state
from tiltframe.operators.recency import with_staleness
from tiltframe.params import OnlineParams, SnapshotParams
from tiltframe.plans.common import ev_points, ev_state
from tiltframe.session import new_run_dir
from tiltframe.streaming.online import OnlineClusterer

P = OnlineParams(q=8, dim=2, min_init_points=100, m=20, delta=5, init="streaming")


def _rows(df):
    return sorted(
        (r["slot"], tuple(r["ids"]), r["n"], tuple(round(v, 6) for v in r["cf1x"]), tuple(round(v, 4) for v in r["cf2x"]), r["cf1t"], r["cf2t"])
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def full_run(spark):
    m = OnlineClusterer(spark, P, snapshot=SnapshotParams(2, 2))
    m.run_ticks(ev_points(spark, SF_SMALL))
    return m


def test_online_invariants(spark, full_run):
    m = full_run
    st = m.state().collect()
    total = ev_points(spark, SF_SMALL).count()
    assert len(st) == P.q
    assert m.total == total
    assert m.time == 30
    assert sum(r["n"] for r in st) <= total
    assert all(r["n"] >= 0 for r in st)
    assert m.progress[-1][2] == total
    # ids are unique across slots
    ids = [i for r in st for i in r["ids"]]
    assert len(ids) == len(set(ids))
    # snapshots = states kept on the pyramidal frame
    kept = sorted(int(r["tick"]) for r in m.states().select("tick").distinct().collect())
    assert kept[-1] == 30 and 16 in kept and 1 not in kept


def test_restart_resumes(spark, full_run):
    base = new_run_dir(spark, "restart")
    pts = ev_points(spark, SF_SMALL)
    a = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))
    a.run_ticks(pts, last_tick=14)
    b = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))  # a new driver
    assert b.time == a.time and b.total == a.total
    b.run_ticks(pts)
    assert _rows(b.state()) == _rows(full_run.state())


def test_replayed_batch_is_skipped(spark, full_run):
    before = _rows(full_run.state())
    full_run.step(ev_points(spark, SF_SMALL).where("tick = 29"), 29)
    assert _rows(full_run.state()) == before
    with pytest.raises(ValueError, match="older than the clock"):
        full_run.step(ev_points(spark, SF_SMALL).where("tick = 3"), 3)


def test_stream_equals_batch(spark, full_run, tmp_path):
    pts = ev_points(spark, SF_SMALL)
    src = str(tmp_path / "src")
    for lo, hi in [(0, 10), (10, 20), (20, 30)]:
        pts.where((F.col("tick") >= lo) & (F.col("tick") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    m = OnlineClusterer(spark, P, snapshot=SnapshotParams(2, 2))
    q = m.start(stream, checkpoint=str(tmp_path / "ckpt"), mode="event", trigger={"availableNow": True})
    q.awaitTermination()
    assert m.time < 30  # the newest tick waits: it may go on in a later trigger
    m.flush()
    assert m.time == 30 and m.rejects().count() == 0
    assert _rows(m.state()) == _rows(full_run.state())


def _stream(spark, m, parts, tmp_path, name, **kw):
    """One trigger per frame of ``parts``, in order."""
    fn = m.foreach_batch("event", **kw)
    for i, df in enumerate(parts):
        fn(df, i)
    return m


def test_tick_over_two_triggers(spark, full_run, tmp_path):
    pts = ev_points(spark, SF_SMALL)
    cut = F.col("id") % 2 == 0
    parts = [pts.where("tick < 10"), pts.where((F.col("tick") == 10) & cut), pts.where((F.col("tick") == 10) & ~cut), pts.where("tick > 10")]
    m = _stream(spark, OnlineClusterer(spark, P, snapshot=SnapshotParams(2, 2)), parts, tmp_path, "two").flush()
    assert m.total == pts.count() and m.rejects().count() == 0
    assert _rows(m.state()) == _rows(full_run.state())


def test_replayed_trigger_changes_nothing(spark, full_run):
    pts = ev_points(spark, SF_SMALL)
    base = new_run_dir(spark, "replay")
    m = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))
    for i, (lo, hi) in enumerate([(0, 12), (12, 20), (20, 30)]):
        m.foreach_batch("event")(pts.where((F.col("tick") >= lo) & (F.col("tick") < hi)), i)
        m = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))  # a new driver replays
        m.foreach_batch("event")(pts.where((F.col("tick") >= lo) & (F.col("tick") < hi)), i)
    m.flush()
    assert m.rejects().count() == 0 and m.total == pts.count()
    assert _rows(m.state()) == _rows(full_run.state())


def test_points_that_cannot_be_folded_are_kept(spark):
    schema = "id long, x array<double>, tick long"
    good = [(i, [float(i), 1.0], 5 + i % 3) for i in range(60)]
    bad = [(100, [1.0, 2.0], None), (101, [1.0, 2.0], -4), (102, None, 6), (103, [1.0], 6), (104, [1.0, float("nan")], 6), (105, [None, 1.0], 6)]
    p = OnlineParams(q=4, dim=2, init="random")
    want = {"null_tick": 1, "late": 1, "broken_vector": 4}
    for run in (lambda m, df: m.run_ticks(df), lambda m, df: (m.foreach_batch("event")(df, 0), m.flush())):
        m = OnlineClusterer(spark, p)
        run(m, spark.createDataFrame(good + bad, schema))
        assert m.total == 60 and m.time == 8
        assert {r["reason"]: r["count"] for r in m.rejects().groupBy("reason").count().collect()} == want
    # late in a later trigger: kept, not folded
    m.foreach_batch("event")(spark.createDataFrame([(200, [1.0, 1.0], 5), (201, [1.0, 1.0], 9)], schema), 1)
    m.flush()
    assert m.total == 61 and m.rejects().where("reason = 'late'").count() == 2
    one = OnlineClusterer(spark, p)
    one.step(spark.createDataFrame(good + bad[2:], schema), 0)
    assert one.total == 60 and one.rejects().count() == 4


def test_large_ticks_raise_instead_of_wrapping(spark):
    p = OnlineParams(q=2, dim=1, init="random")
    df = spark.createDataFrame([(i, [float(i)], 1_700_000_000) for i in range(8)], "id long, x array<double>, tick long")
    with pytest.raises(Exception, match="64 bits"):
        OnlineClusterer(spark, p).run_ticks(df)


def test_assignment_partition_independent(spark):
    pts = ev_points(spark, SF_SMALL)
    st = ev_state(spark, SF_SMALL, q=8, split=10)
    view = collect_view(st)
    a = sorted((r["id"], r["slot"]) for r in assign(pts.repartition(1), view).collect())
    b = sorted((r["id"], r["slot"]) for r in assign(pts.repartition(7), view).collect())
    c = sorted((r["id"], r["slot"]) for r in assign_sql(pts, st).collect())
    assert a == b == c


def test_fused_update_equals_operator_composition(spark):
    p = OnlineParams(q=12, dim=2, m=20, delta=5)
    st = ev_state(spark, SF_SMALL, q=12, split=20)
    batch = ev_points(spark, SF_SMALL).where("tick >= 20").withColumn("tick", F.lit(20).cast("long"))
    view = collect_view(st)
    a = assign(batch, view, t_factor=p.t_factor)
    sums = cf_aggregate(a.where("inside"), 2, "x", "tick")
    outl = a.where(~F.col("inside")).select(F.col("tick").alias("seq_tick"), F.col("id").alias("seq_id"), "x")
    assert outl.count() > 0
    fused = update_state(st, sums, outl, p, 20)
    applied = cf_apply(st, sums)
    composed = absorb_outliers(applied, outl, p, 20)
    assert _rows(state_rows(fused)) == _rows(state_rows(composed))
    assert sorted(merge_rows(fused).collect()) == sorted(merge_rows(composed).collect())
    # the stamps are those of the DataFrame form
    stale = {r["slot"] for r in with_staleness(applied, 20, p.delta, p.m).where("stale").collect()}
    taken = {r["slot"] for r in state_rows(fused).where("ids[0] >= 12").collect()}
    assert min(len(stale), len(taken)) == len(stale & taken)
    # without outliers the fused update is the plain apply + refresh
    assert _rows(state_rows(update_state(st, sums, None, p, 20))) == _rows(refresh(applied))
    # nothing in, nothing out; broken rows alone are counted
    assert update_state(st, sums.limit(0), outl.limit(0), p, 20).count() == 0
    broken = sums.limit(0).unionByName(sums.limit(1).select(F.lit(None).cast("int").alias("slot"), F.lit(4).cast("long").alias("n"), *[c for c in sums.columns if c not in ("slot", "n")]), allowMissingColumns=True)
    assert {(r["n_batch"], r["n_broken"]) for r in update_state(st, broken, None, p, 20).collect()} == {(0, 4)}


def test_state_does_not_depend_on_partitions(spark):
    p = OnlineParams(q=6, dim=2, min_init_points=0, m=20, delta=2, max_candidates=10)
    runs = []
    for parts in (1, 3, 8):
        m = OnlineClusterer(spark, p)
        for t in range(7):
            m.step(ev_points(spark, SF_SMALL).where(F.col("tick") == t).repartition(parts), t)
        assert m.state().count() == 6
        runs.append(_rows(m.state()))
    assert runs[0] == runs[1] == runs[2]


def test_batch_kmeans_start_survives_restart_and_replay(spark):
    p = OnlineParams(q=5, dim=2, min_init_points=150, init="kmeans", m=20, delta=5)
    pts = ev_points(spark, SF_SMALL)
    day = lambda t: pts.where(F.col("tick") == t)
    plain = OnlineClusterer(spark, p)
    base = new_run_dir(spark, "kmeans-restart")
    for t in range(8):
        plain.step(day(t), t)
        m = OnlineClusterer(spark, p, base_dir=base)
        m.step(day(t), t)
        m = OnlineClusterer(spark, p, base_dir=base)
        m.step(day(t), t)  # replay by a new driver
        assert (m.time, m.total) == (plain.time, plain.total)
    assert plain.initialized and _rows(m.state()) == _rows(plain.state())


def test_init_routes(spark):
    pts = ev_points(spark, SF_SMALL)
    for init, min_init in [("random", 0), ("kmeans", 100), ("streaming", 100)]:
        m = OnlineClusterer(spark, OnlineParams(q=5, dim=2, min_init_points=min_init, init=init))
        m.run_ticks(pts, last_tick=6)
        assert m.initialized and m.state().count() == 5


def test_milestone_hook_writes_centers(spark, tmp_path):
    from tiltframe.streaming.online import Milestones

    total = ev_points(spark, SF_SMALL).count()
    sink = str(tmp_path / "centers")
    ms = Milestones([total // 2], band=40, horizon=8, k=3, sink=sink)
    m = OnlineClusterer(spark, P, snapshot=SnapshotParams(2, 2), milestones=ms)
    m.run_ticks(ev_points(spark, SF_SMALL))
    lines = spark.read.text(sink).collect()
    assert len(lines) >= 3 and all(len(r["value"].split(",")) == 2 for r in lines)
    assert m.macro_at(m.time, 8, 3).count() == 3
    drawn = m.macro_at(m.time, 8, 3, num_points=2000).collect()
    assert len(drawn) == 3 and sum(r["weight"] for r in drawn) == 2000
    assert m.macro_now(4).agg(F.sum("weight")).first()[0] == m.state().agg(F.sum("n")).first()[0]


def test_merge_preserves_cf_totals(spark):
    from tiltframe.operators.maintain import closest_pair, merge_pair

    st = ev_state(spark, SF_SMALL, q=12, split=20)
    sws = with_staleness(st, 20, 5, 20)
    merged = merge_pair(st, closest_pair(sws))
    tot = lambda df: df.agg(F.sum("n"), F.sum(F.col("cf1x")[0]), F.sum(F.col("cf2x")[1]), F.sum("cf1t"), F.sum("cf2t")).first()
    a, b = tot(st), tot(merged)
    assert a[0] == b[0] and a[3] == b[3] and a[4] == b[4]
    assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
    assert merged.where("n = 0").count() >= 1


def test_horizon_counts_non_negative_on_online_snapshots(spark, full_run):
    from tiltframe.operators import snapshots as sn

    snaps = sn.read_snapshots(spark, full_run.snapshot_path).select("tick", "slot", "ids", "n", "cf1x", "cf2x", "cf1t", "cf2t")
    req = spark.createDataFrame([(30, h) for h in (1, 2, 5, 8, 16)], "tc bigint, h bigint")
    hc = sn.horizon_clusters(snaps, req)
    assert hc.count() == 5 * P.q
    assert hc.where("n < 0").count() == 0
    # an exact horizon never holds more points than the batches inside it
    prog = {t: n for t, n, _ in full_run.progress}
    for r in hc.where("horizon_exact").groupBy("tc", "h", "t1", "t2").agg(F.sum("n").alias("n")).collect():
        assert r["n"] <= sum(v for t, v in prog.items() if r["t2"] < t <= r["t1"])


def test_restart_during_start_phase(spark, full_run):
    base = new_run_dir(spark, "restart-start")
    pts = ev_points(spark, SF_SMALL)
    a = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))
    a.run_ticks(pts, last_tick=1)  # ~66 points < 100: still in the start phase
    assert not a.initialized
    b = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 2))
    assert (b.time, b.total) == (a.time, a.total)
    b.run_ticks(pts)
    assert _rows(b.state()) == _rows(full_run.state())


def test_progress_listener_counts_stream_rows(spark, tmp_path):
    import time

    from tiltframe.streaming.progress import ProgressListener

    pts = ev_points(spark, SF_SMALL)
    src = str(tmp_path / "src")
    for lo, hi in [(0, 15), (15, 30)]:
        pts.where((F.col("tick") >= lo) & (F.col("tick") < hi)).coalesce(1).write.mode("append").parquet(src)
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(src)
        m = OnlineClusterer(spark, P)
        q = m.start(stream, checkpoint=str(tmp_path / "ckpt"), mode="event", trigger={"availableNow": True})
        q.awaitTermination()
        m.flush()
        time.sleep(2)  # listener events are delivered asynchronously
        rows = listener.table(spark).collect()
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["n_batch"] for r in rows) == pts.count() == m.total
