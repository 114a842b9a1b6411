"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the test tables.
Computed doubles are rounded (same digits as the oracle SQL) so that sums
taken in different orders compare equal; vectors are exploded to
``(…, pos, value)`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import explode_vec
from ..operators import macro as mac
from ..operators import snapshots as sn
from ..operators.assign import assign, collect_view
from ..operators.features import cf_aggregate, empty_state, nearest_other_distance
from ..operators.kmeans import decay_from_half_life, kmeans_cost, lloyd, streaming_kmeans_update
from ..operators.maintain import absorb_outliers, closest_pair, merge_pair, merge_rows, replace_stale, state_rows
from ..operators.lineage import members, related, with_members
from ..operators.rank import numbered
from ..operators.recency import with_staleness, relevance_stamp
from ..params import OnlineParams, SnapshotParams
from ..session import new_run_dir
from ..sources.tables import embedding_points, event_tick, lineitem_points, table
from ..sources.text import parse_vectors, read_text_points, render_vectors
from .common import (
    DELTA_DAYS,
    DELTA_HOURS,
    EMB_Q,
    EV_Q,
    EV_SPLIT,
    M_LAST,
    MANY_Q,
    T_FACTOR,
    emb_state,
    ev_points,
    ev_state,
    pair_snapshot_at,
    r,
    seeds,
    user_snapshot_at,
)

SNAP = SnapshotParams(alpha=2, l=2)
# Fixed requests (tc, h) of the horizon queries: the offline demo's four
# horizons plus edge cases (horizon reaching before the oldest snapshot,
# clock before any snapshot, no snapshot at or before tc).
REQUESTS = [(6, 1), (21, 1), (29, 5), (30, 16), (30, 29), (7, 2), (0, 1)]
MILESTONES = [2500, 5000, 7500]
MIN_INIT = 200  # points before the online phase starts (reached at every scale)
MILESTONE_BAND = 100
DRAW_SEED = 7
MARK_BAND, MARK_HORIZON = 40, 8
EV_HALF = 15  # first day of the second batch of the two-batch start


def _requests(spark):
    return spark.createDataFrame(REQUESTS, "tc bigint, h bigint")


# -- sources ------------------------------------------------------------------


def parse_vectors_q(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1/SRC2: lineitem rendered as text lines (4 numbers + a label
    token), parsed back with the label dropped."""
    li = table(spark, sf, "lineitem")
    line = F.concat_ws(
        " ",
        *[F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")],
    )
    lines = li.select("l_orderkey", "l_linenumber", line.alias("value"))
    pts, _rejects = parse_vectors(lines, "value", dim=4, drop_label=True)
    return pts.select(
        "l_orderkey", "l_linenumber", "label",
        F.size("x").alias("dims"),
        *[F.col("x")[i].alias(f"x{i}") for i in range(4)],
    )


def stream_source_q(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3/SRC4: events written as text files ordered by time (one folder
    of files per day group), then read back as a file stream, one file per
    trigger, parsed with SRC1; the rows collected by a foreachBatch sink that
    writes each batch to its own folder (a replayed batch overwrites it)."""
    base = new_run_dir(spark, "stream_source")
    ev = ev_points(spark, sf)
    lines = ev.select(
        F.floor(F.col("tick") / 10).alias("part"),
        F.concat_ws(" ", F.col("id").cast("string"), F.col("x")[0].cast("string"), F.col("x")[1].cast("string")).alias("value"),
    )
    lines.repartition("part").write.mode("overwrite").partitionBy("part").text(f"{base}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").text(f"{base}/in")
    out = f"{base}/out"

    def sink(df, batch_id):
        pts, _ = parse_vectors(df, "value", dim=3)
        pts.select("x").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    return got.select(
        F.col("x")[0].cast("long").alias("id"), F.col("x")[1].alias("x0"), F.col("x")[2].alias("x1")
    )


# -- online: clock, assignment, CFs ---------------------------------------------


def tick_counters_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON2: hourly clock over events, empty ticks included: points in the
    tick and running total."""
    ev = table(spark, sf, "events").select(event_tick("ts", 3600).alias("tick"))
    counts = ev.groupBy("tick").agg(F.count(F.lit(1)).alias("n_batch"))
    span = ev.agg(F.max("tick").alias("mx")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx"))).alias("tick"))
    allt = span.join(counts, "tick", "left").select("tick", F.coalesce("n_batch", F.lit(0)).cast("long").alias("n_batch"))
    w = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return allt.select("tick", "n_batch", F.sum("n_batch").over(w).cast("long").alias("n_total"))


def progress_q(spark: SparkSession, sf: str) -> DataFrame:
    """SNK2: one progress row per non-empty hourly batch: clock after the
    batch, its size, total so far."""
    t = tick_counters_q(spark, sf).where(F.col("n_batch") > 0)
    return t.select((F.col("tick") + 1).alias("tc"), "n_batch", F.col("n_total").alias("n"))


def milestones_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF7: batches after which the running total lies within the band of
    a milestone (mark - band < n <= mark + band)."""
    p = progress_q(spark, sf)
    marks = spark.createDataFrame([(m,) for m in MILESTONES], "mark bigint")
    cond = (F.col("n") > F.col("mark") - MILESTONE_BAND) & (F.col("n") <= F.col("mark") + MILESTONE_BAND)
    return p.join(F.broadcast(marks), cond).select("tc", "n", "mark")


def assign_nearest_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON6: nearest of 10 seeded micro-clusters for every embedding."""
    pts = embedding_points(spark, sf)
    st0 = empty_state(spark, seeds(pts, EMB_Q), 64, "center")
    a = assign(pts, collect_view(st0))
    return a.select("id", "slot", r("d2", 6).alias("d2"))


def assign_many_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON6: nearest of 1,000 seeded micro-clusters for every event (found
    through the index over the centers)."""
    pts = ev_points(spark, sf)
    st0 = empty_state(spark, seeds(pts, MANY_Q), 2, "center")
    a = assign(pts, collect_view(st0))
    return a.select("id", "slot", r("d2", 6).alias("d2"))


def split_outliers_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON7: after one batch, the inside/outlier split against the refreshed
    micro-clusters (inside iff distance <= t * rmsd)."""
    pts = embedding_points(spark, sf)
    st = emb_state(spark, sf)
    a = assign(pts, collect_view(st), t_factor=T_FACTOR)
    return a.select("id", "slot", "inside", r("d2", 6).alias("d2"))


def cf_aggregate_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON8: per micro-cluster count, linear and squared sums."""
    pts = embedding_points(spark, sf)
    st0 = empty_state(spark, seeds(pts, EMB_Q), 64, "center")
    agg = cf_aggregate(assign(pts, collect_view(st0)), 64, "x", None)
    z = agg.select("slot", "n", F.arrays_zip("cf1x", "cf2x").alias("z"))
    e = z.select("slot", "n", F.posexplode("z").alias("pos", "v"))
    return e.select("slot", "n", "pos", r("v.cf1x", 6).alias("cf1x"), r("v.cf2x", 6).alias("cf2x"))


def cf_apply_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON9: state of days < 20 plus the CF sums of the later days assigned
    to its micro-clusters (time sums use each point's day)."""
    st = ev_state(spark, sf)
    batch = ev_points(spark, sf).where(F.col("tick") >= EV_SPLIT)
    from ..operators.features import cf_apply

    sums = cf_aggregate(assign(batch, collect_view(st)), 2, "x", "tick")
    s1 = cf_apply(st, sums)
    return s1.select(
        "slot", "n", "cf1t", "cf2t",
        r(F.col("cf1x")[0], 4).alias("cf1x0"), r(F.col("cf1x")[1], 4).alias("cf1x1"),
        r(F.col("cf2x")[0], 4).alias("cf2x0"), r(F.col("cf2x")[1], 4).alias("cf2x1"),
    )


def refresh_rmsd_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON10: centroid and RMSD after one batch."""
    st = emb_state(spark, sf)
    e = explode_vec(st.select("slot", "n", "rmsd", "centroid"), "centroid", "centroid")
    return e.select("slot", "n", "pos", r("centroid", 6).alias("centroid"), r("rmsd", 6).alias("rmsd"))


def singleton_radius_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON11: distance of every micro-cluster to its nearest other centroid
    (the radius given to singletons)."""
    st = emb_state(spark, sf)
    return nearest_other_distance(st).select("slot", r("nn_dist", 6).alias("nn_dist"))


def _user_hourly(spark, sf):
    ev = table(spark, sf, "events").select("user_id", event_tick("ts", 3600).alias("tick"))
    cf = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tick").alias("cf1t"), F.sum(F.col("tick") * F.col("tick")).alias("cf2t")
    )
    now = ev.agg((F.max("tick") + 1).alias("now"))
    return cf, now


def relevance_stamp_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON12: relevance stamp of each user's events (hourly ticks, m = 20)."""
    cf, _ = _user_hourly(spark, sf)
    return cf.select("user_id", "n", r(relevance_stamp("n", "cf1t", "cf2t", M_LAST), 4).alias("stamp"))


def stale_slots_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON13: stale users (stamp < now - delta) in replacement order."""
    cf, now = _user_hourly(spark, sf)
    st = with_staleness(cf.crossJoin(F.broadcast(now)), F.col("now"), DELTA_HOURS, M_LAST)
    stale = st.where("stale").select("user_id", r("stamp", 4).alias("stamp"))
    return numbered(stale, ["user_id"], "stale_rank").withColumn("stale_rank", F.col("stale_rank").cast("int"))


def _ev_batch_outliers(spark, sf):
    st = ev_state(spark, sf)
    batch = ev_points(spark, sf).where(F.col("tick") >= EV_SPLIT)
    a = assign(batch, collect_view(st), t_factor=T_FACTOR)
    outl = a.where(~F.col("inside")).select(F.col("tick").alias("seq_tick"), F.col("id").alias("seq_id"), "x")
    return st, outl


def _state_out(df: DataFrame, extra: tuple = (), view: bool = False) -> DataFrame:
    seen = [r(F.col("centroid")[0], 4).alias("c0"), r(F.col("centroid")[1], 4).alias("c1"), r("rmsd", 4).alias("rmsd")] if view else []
    return df.select(
        *extra,
        "slot",
        F.array_join("ids", ",").alias("ids"),
        "n", "cf1t", "cf2t",
        r(F.col("cf1x")[0], 4).alias("cf1x0"), r(F.col("cf1x")[1], 4).alias("cf1x1"),
        r(F.col("cf2x")[0], 4).alias("cf2x0"), r(F.col("cf2x")[1], 4).alias("cf2x1"),
        *seen,
    )


def replace_stale_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON15/ON18: without absorption the j-th outlier of the later days takes
    the j-th stale slot (fresh CF, new id = max id + j, radius to the nearest
    other centroid)."""
    st, outl = _ev_batch_outliers(spark, sf)
    sws = with_staleness(st, EV_SPLIT, DELTA_DAYS, M_LAST)
    return _state_out(replace_stale(sws, outl)[0], view=True)


def closest_pair_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON16: closest pair of non-stale micro-clusters."""
    st = ev_state(spark, sf)
    sws = with_staleness(st, EV_SPLIT, DELTA_DAYS, M_LAST)
    return closest_pair(sws).select("slot_a", "slot_b", r("d2", 4).alias("d2"))


def merge_pair_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON17: the closest non-stale pair merged (ids concatenated)."""
    st = ev_state(spark, sf)
    sws = with_staleness(st, EV_SPLIT, DELTA_DAYS, M_LAST)
    return _state_out(merge_pair(st, closest_pair(sws)), view=True)


def absorb_outliers_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON14 (whole rule, as the engine runs it): outliers of the later days
    absorbed, given stale slots or merged in arrival order; ids listed whole
    from the merges. Order dependent: checked against a brute-force loop in
    the tests."""
    st, outl = _ev_batch_outliers(spark, sf)
    p = OnlineParams(q=EV_Q, dim=2, m=M_LAST, delta=DELTA_DAYS, t_factor=T_FACTOR)
    folder = new_run_dir(spark, "absorb")
    absorb_outliers(st, outl, p, EV_SPLIT).write.parquet(folder)
    step = spark.read.parquet(folder)
    return _state_out(with_members(state_rows(step), merge_rows(step)))


# -- init routes and the full online loop ---------------------------------------


def _online(spark, sf, init: str, min_init: int, snapshot=None):
    from ..streaming.online import OnlineClusterer

    p = OnlineParams(q=EV_Q, dim=2, min_init_points=min_init, m=M_LAST, delta=DELTA_DAYS, init=init)
    m = OnlineClusterer(spark, p, snapshot=snapshot)
    return m


def init_random_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON3: random start (seeded uniform centroids) with every event as the
    first batch."""
    m = _online(spark, sf, "random", 0)
    m.step(ev_points(spark, sf), 0)
    return _state_out(m.state())


def init_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON4: every event buffered (at least 200 points), then batch k-means
    with q centers."""
    m = _online(spark, sf, "kmeans", MIN_INIT)
    m.step(ev_points(spark, sf), 0)
    return _state_out(m.state())


def init_streaming_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON5: streaming k-means over two batches (days before and from
    ``EV_HALF``): the second starts the state, as 200 points or more came
    before it."""
    m = _online(spark, sf, "streaming", min(MIN_INIT, 100))
    half = (F.col("tick") >= EV_HALF).cast("long")
    m.run_ticks(ev_points(spark, sf).withColumn("tick", half))
    return _state_out(m.state(whole_ids=True))


def online_totals_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON1/ON14: every day of events folded by the engine with a staleness
    threshold beyond the table's span, so that nothing is forgotten: the
    state's totals are those of the points."""
    from ..streaming.online import OnlineClusterer

    p = OnlineParams(q=EV_Q, dim=2, m=M_LAST, delta=1000, init="random")
    m = OnlineClusterer(spark, p).run_ticks(ev_points(spark, sf))
    return _totals(m.state())


def _totals(st: DataFrame) -> DataFrame:
    return st.agg(
        F.sum("n").alias("n"), F.sum("cf1t").alias("cf1t"), F.sum("cf2t").alias("cf2t"),
        *[r(F.sum(F.col(c)[i]), 2).alias(f"{c}{i}") for c in ("cf1x", "cf2x") for i in range(2)],
    )


def online_run_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON1/ON19: every day of events through the online phase (streaming
    k-means start), snapshots on the pyramidal frame; final state."""
    m = _online(spark, sf, "streaming", MIN_INIT, snapshot=SNAP)
    m.run_ticks(ev_points(spark, sf))
    return _state_out(m.state(whole_ids=True))


def online_horizon_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF6 over the online phase's own snapshots: horizon micro-clusters
    and k = 3 macro-clusters for each request."""
    m = _online(spark, sf, "streaming", MIN_INIT, snapshot=SNAP)
    m.run_ticks(ev_points(spark, sf))
    snaps = sn.read_snapshots(spark, m.snapshot_path).select("tick", "slot", "ids", "n", "cf1x", "cf2x", "cf1t", "cf2t")
    hc = sn.horizon_clusters(snaps, _requests(spark), log=m.merges())
    cw = mac.centers_and_weights(hc, ["tc", "h"])
    mk = mac.macro_kmeans(cw.withColumn("w", F.col("n").cast("double")), 3, 20, 1e-4, ["tc", "h"], "w")
    return mk.select("tc", "h", "cluster", r("weight", 4).alias("weight"), r(F.col("center")[0], 4).alias("c0"), r(F.col("center")[1], 4).alias("c1"))


def milestone_centers_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF7: every day of events through the online phase; each time the
    running total falls in the band of a quarter of all points, the last
    ``MARK_HORIZON`` days are clustered (k = 3). Mark, clock, total, centers."""
    from ..streaming.online import Milestones, OnlineClusterer

    pts = ev_points(spark, sf)
    total = pts.count()
    marks = Milestones([total * i // 4 for i in (1, 2, 3)], band=total // MARK_BAND + 1, horizon=MARK_HORIZON, k=3)
    p = OnlineParams(q=EV_Q, dim=2, min_init_points=min(MIN_INIT, total // 10), m=M_LAST, delta=DELTA_DAYS, init="streaming")
    m = OnlineClusterer(spark, p, snapshot=SNAP, milestones=marks).run_ticks(pts)
    out = m.milestone_centers()
    return out.select("mark", F.col("tick").alias("tc"), "n_total", "cluster", r("weight", 4).alias("weight"), r(F.col("center")[0], 4).alias("c0"), r(F.col("center")[1], 4).alias("c1"))


def stream_totals_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON1/SRC4: events as text files, six days each, read as a file stream
    (one file a trigger), parsed and folded by the engine in event mode
    (ticks of six days), nothing forgotten: the totals are those of the
    points."""
    from ..sources.stream import text_file_stream
    from ..streaming.online import OnlineClusterer

    base = new_run_dir(spark, "stream_totals")
    ev = ev_points(spark, sf)
    lines = ev.select(
        F.floor(F.col("tick") / 6).alias("part"),
        F.concat_ws(" ", F.col("x")[0].cast("string"), F.col("x")[1].cast("string"), F.col("id").cast("string"), F.floor(F.col("tick") / 6).cast("string")).alias("value"),
    )
    # files in the order of their names, so triggers go through time
    lines.repartitionByRange("part").sortWithinPartitions("part").write.partitionBy("part").text(f"{base}/in")
    points, _ = text_file_stream(spark, f"{base}/in/*", dim=4)
    points = points.select(F.slice("x", 1, 2).alias("x"), F.col("x")[2].cast("long").alias("id"), F.col("x")[3].cast("long").alias("tick"))
    p = OnlineParams(q=EV_Q, dim=2, m=M_LAST, delta=1000, init="random")
    m = OnlineClusterer(spark, p, base_dir=f"{base}/model")
    m.start(points, mode="event", lateness=10, trigger={"availableNow": True}).awaitTermination()
    return _totals(m.flush().state())


def text_scan_q(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3: events written as a folder of text files, read back by the batch
    scan of point lines."""
    path = new_run_dir(spark, "text_scan")
    ev = ev_points(spark, sf).select(F.concat(F.array(F.col("id").cast("double")), "x").alias("x"))
    render_vectors(ev, "x").write.text(path)
    pts, _ = read_text_points(spark, path, dim=3)
    return pts.select(F.col("x")[0].cast("long").alias("id"), F.col("x")[1].alias("x0"), F.col("x")[2].alias("x1"))


# -- snapshots --------------------------------------------------------------------


def _clock_T(spark, sf):
    ev = table(spark, sf, "events").select(event_tick("ts", 3600).alias("tick"))
    return ev.agg((F.max("tick") + 1).alias("T"))


def snapshot_order_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN1/SN3: for every hourly clock 1..T of events: snapshot order and
    whether its snapshot is still kept at T (alpha = 2, l = 2)."""
    return sn.schedule(spark, _clock_T(spark, sf), SNAP)


def snapshot_live_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN3: the live snapshot ticks at T with their expiry clock."""
    s = sn.schedule(spark, _clock_T(spark, sf), SNAP).where("live")
    return s.select("tick", "snap_order", sn.expiry_of("tick", SNAP.alpha, SNAP.l).alias("expires"))


def _daily_live(spark, sf):
    """Live daily snapshot ticks at T = days of events."""
    ev = ev_points(spark, sf).agg((F.max("tick") + 1).alias("T"))
    return sn.schedule(spark, ev, SNAP).where("live").select("tick")


def snapshot_pair_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN4: (t1, t2) for each request against the live daily snapshots."""
    return sn.snapshot_pairs(_requests(spark), _daily_live(spark, sf))


def _pair_log(spark, sf, tc: int, tick: int) -> tuple[DataFrame, DataFrame]:
    """The user pairs of a snapshot as primary ids, and the log of the merges
    that made them at ``tick``."""
    pairs = pair_snapshot_at(spark, sf, tc)
    log = pairs.where(F.size("ids") > 1).select(
        F.col("ids")[1].alias("id"), F.col("ids")[0].alias("into"), F.col("ids")[0].alias("after"), F.col("slot").cast("long").alias("seq"), F.lit(tick).cast("long").alias("tick")
    )
    return pairs.withColumn("ids", F.slice("ids", 1, 1)), log


def lineage_match_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN5: micro-clusters of the day-20 snapshot (user pairs, merged on day
    15) related through the merge log to those of the day-10 snapshot (single
    users)."""
    s1, log = _pair_log(spark, sf, 20, 15)
    s2 = user_snapshot_at(spark, sf, 10).withColumn("t1", F.lit(20).cast("long")).withColumnRenamed("tick", "t2")
    return related(s1, s2, log, "t1", "t2")


def horizon_subtract_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN6: day-20 snapshot minus the related day-10 micro-clusters (h = 10),
    relation and remaining ids from the merge log."""
    s1, log = _pair_log(spark, sf, 20, 15)
    s2 = user_snapshot_at(spark, sf, 10).drop("tick")
    out = sn.horizon_subtract(s1, s2, 10, 20, 10, log=log)
    gained = sn.horizon_members(s1, s2, log, 20, 10).groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_l"))
    out = out.join(gained, "slot", "left").withColumn("ids", F.coalesce(F.col("_l.id"), F.array().cast("array<bigint>"))).drop("_l")
    return _state_out(out, ("horizon_exact",))


def lineage_members_q(spark: SparkSession, sf: str) -> DataFrame:
    """ON18: users chained into one micro-cluster per ten (each merge follows
    the last one's list), the lists read back from the merge log by pointer
    doubling: slot, place in the list, id."""
    users = user_snapshot_at(spark, sf, 20).select(F.col("slot").cast("long").alias("id"))
    group = users.withColumn("g", F.floor(F.col("id") / 10))
    before = F.lag("id").over(Window.partitionBy("g").orderBy("id"))
    first = F.min("id").over(Window.partitionBy("g"))
    chained = group.select("id", first.alias("into"), before.alias("after"), F.col("id").alias("seq"), F.lit(5).cast("long").alias("tick"))
    log = chained.where("after IS NOT NULL")
    state = chained.where("after IS NULL").select(F.floor(F.col("id") / 10).cast("int").alias("slot"), F.array("id").alias("ids"))
    return members(state, log)


def snapshot_roundtrip_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN2/SN3/SRC6: user snapshots of every day written to a tick-partitioned
    table, the ones out of the time frame expired, then the latest kept
    snapshot up to day 28 read back by partition pruning."""
    path = new_run_dir(spark, "snapshots")
    days = int(ev_points(spark, sf).agg(F.coalesce(F.max("tick"), F.lit(-1))).first()[0]) + 1  # the clock: one scalar
    snaps = user_snapshot_at(spark, sf, None, spark.range(1, days + 1).select(F.col("id").alias("tick")))
    snaps.repartition("tick").write.mode("overwrite").partitionBy("tick").parquet(path)
    sn.expire_all(spark, path, days, SNAP)
    kept = snaps.limit(0) if days < 1 else sn.read_snapshots(spark, path)
    latest = kept.where("tick <= 28").agg(F.coalesce(F.max("tick"), F.lit(-1))).first()[0]
    return _state_out(sn.snapshot_at(kept, int(latest)))


def snapshot_text_q(spark: SparkSession, sf: str) -> DataFrame:
    """SN7: text block per micro-cluster for snapshots up to day 12."""
    live = _daily_live(spark, sf)
    snaps = user_snapshot_at(spark, sf, None, live)
    return sn.snapshot_text(snaps, 12, fmt="%.4f")


def horizon_sweep_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF6: for every request: snapshot pair, horizon micro-clusters,
    their centers and weights (one plan for all requests)."""
    live = _daily_live(spark, sf)
    snaps = user_snapshot_at(spark, sf, None, live)
    hc = sn.horizon_clusters(snaps, _requests(spark), live)
    # centers are reported as their linear sums (n x center): exact decimals
    # of the input, so no half-way rounding differs between engines
    j = mac.centers_and_weights(hc, ["tc", "h"], keep=("t1", "t2", "cf1x"))
    return j.select(
        "tc", "h", "t1", "t2", "slot", "n",
        r("weight", 9).alias("weight"),
        r(F.col("cf1x")[0], 4).alias("s0"), r(F.col("cf1x")[1], 4).alias("s1"),
    )


# -- offline ------------------------------------------------------------------------


def _label_mcs(spark, sf):
    """Embeddings grouped by label as micro-clusters (slot = label)."""
    pts = embedding_points(spark, sf)
    return cf_aggregate(pts.withColumnRenamed("label", "slot"), 64, "x", None)


def macro_centers_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF1: micro-cluster centers (n > 0)."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf))
    e = explode_vec(cw.select("slot", "center"), "center", "center")
    return e.select("slot", "pos", r("center", 6).alias("center"))


def macro_weights_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF2: micro-cluster weights n / sum n."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf))
    return cw.select("slot", "n", r("weight", 9).alias("weight"))


def weighted_sample_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF3: 5,000 draws by weight (deterministic u = (i + 0.5)/N)."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf))
    s = mac.weighted_sample(cw, 5000, deterministic=True)
    return s.select("slot", "draws")


def weighted_draws_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF3: 5,000 random draws by weight, from the counter-based generator."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf))
    return mac.weighted_sample(cw, 5000, seed=DRAW_SEED).select("slot", "draws")


def drawn_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF4: k-means (k = 5, 20 iterations) on 5,000 random draws, started at 5
    further draws."""
    mk = mac.sampled_macro_kmeans(_label_mcs(spark, sf), 5, 5000, 20, seed=DRAW_SEED, tol=0.0)
    e = explode_vec(mk.select("cluster", "weight", "center"), "center", "center")
    return e.select("cluster", r("weight", 4).alias("weight"), "pos", r("center", 6).alias("center"))


def macro_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF5: weighted k-means (k = 5, weights n, start at the 5 heaviest,
    20 iterations, stop only at a fixed point)."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf)).withColumn("w", F.col("n").cast("double"))
    mk = mac.macro_kmeans(cw, 5, 20, 0.0, None, "w")
    e = explode_vec(mk.select("cluster", "weight", "center"), "center", "center")
    return e.select("cluster", r("weight", 4).alias("weight"), "pos", r("center", 6).alias("center"))


def sampled_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """OFF4: k-means on 5,000 weighted draws (started at 5 draws); the
    draws are deterministic (u = (i + 0.5)/N), so the result is too."""
    mk = mac.sampled_macro_kmeans(_label_mcs(spark, sf), 5, 5000, 20, deterministic=True, tol=0.0)
    e = explode_vec(mk.select("cluster", "weight", "center"), "center", "center")
    return e.select("cluster", r("weight", 4).alias("weight"), "pos", r("center", 6).alias("center"))


def centers_csv_q(spark: SparkSession, sf: str) -> DataFrame:
    """SNK1: macro centers as CSV lines."""
    cw = mac.centers_and_weights(_label_mcs(spark, sf)).withColumn("w", F.col("n").cast("double"))
    mk = mac.macro_kmeans(cw, 5, 20, 0.0, None, "w")
    return mac.centers_csv(mk.select("cluster", "center"), fmt="%.6f")


def micro_macro_q(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship slice: embeddings -> 10 seeded micro-clusters (assign, CF,
    refresh) -> centers/weights -> weighted k-means (k = 3)."""
    st = emb_state(spark, sf)
    cw = mac.centers_and_weights(st).withColumn("w", F.col("n").cast("double"))
    mk = mac.macro_kmeans(cw, 3, 20, 0.0, None, "w")
    e = explode_vec(mk.select("cluster", "weight", "center"), "center", "center")
    return e.select("cluster", r("weight", 4).alias("weight"), "pos", r("center", 6).alias("center"))


# -- baselines ----------------------------------------------------------------------


def kmeans_wssse_q(spark: SparkSession, sf: str) -> DataFrame:
    """BL1: within-set sum of squared errors of 5 given centers (the first
    5 embeddings)."""
    pts = embedding_points(spark, sf)
    c = kmeans_cost(pts, seeds(pts, 5))
    return c.select(r("wssse", 6).alias("wssse"), "n")


def kmeans_train_q(spark: SparkSession, sf: str) -> DataFrame:
    """BL1: k-means with k = 2 over lineitem from its first two points, at most
    20 rounds (to a fixed point): centers, their sizes and the cost."""
    pts = lineitem_points(spark, sf)
    first = pts.orderBy("id", "x").limit(2)  # ids come again in this table
    start = first.select((F.row_number().over(Window.orderBy("id", "x")) - 1).cast("int").alias("slot"), F.col("x").alias("center"))
    centers = lloyd(pts, start, 20, 0.0)
    sizes = assign(pts.select("x"), collect_view(centers, "slot", "center", None)).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    cost = kmeans_cost(pts, centers).select("wssse")
    out = centers.join(sizes, "slot", "left").crossJoin(F.broadcast(cost))  # one row
    return out.select("slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[r(F.col("center")[i], 4).alias(f"c{i}") for i in range(4)], r(F.col("wssse") / 1e9, 6).alias("wssse_1e9"))


def streaming_kmeans_q(spark: SparkSession, sf: str) -> DataFrame:
    """BL2: one update of streaming k-means a day over all days (k = 5,
    half-life 1,000 points, start = first 5 events with weight 1). The input
    is staged by day once; the k-row model is written after every batch."""
    base = new_run_dir(spark, "streaming_kmeans")
    pts = ev_points(spark, sf)
    pts.repartition("tick").write.partitionBy("tick").parquet(f"{base}/in")
    days = spark.read.parquet(f"{base}/in")
    model = seeds(pts, 5).withColumn("weight", F.lit(1.0))
    decay = decay_from_half_life(1000)
    for t in sorted(r["tick"] for r in days.select("tick").distinct().collect()):  # the clock: one row a day
        new = streaming_kmeans_update(model, days.where(F.col("tick") == t), decay, "points")
        new.coalesce(1).write.parquet(f"{base}/model/{t}")
        model = spark.read.schema(new.schema).parquet(f"{base}/model/{t}")
    return model.select(
        "slot", r("weight", 6).alias("weight"), r(F.col("center")[0], 6).alias("c0"), r(F.col("center")[1], 6).alias("c1")
    )


QUERIES = {
    "parse_vectors": parse_vectors_q,
    "stream_source": stream_source_q,
    "text_scan": text_scan_q,
    "tick_counters": tick_counters_q,
    "progress": progress_q,
    "milestones": milestones_q,
    "assign_nearest": assign_nearest_q,
    "assign_many": assign_many_q,
    "split_outliers": split_outliers_q,
    "cf_aggregate": cf_aggregate_q,
    "cf_apply": cf_apply_q,
    "refresh_rmsd": refresh_rmsd_q,
    "singleton_radius": singleton_radius_q,
    "relevance_stamp": relevance_stamp_q,
    "stale_slots": stale_slots_q,
    "replace_stale": replace_stale_q,
    "closest_pair": closest_pair_q,
    "merge_pair": merge_pair_q,
    "absorb_outliers": absorb_outliers_q,
    "init_random": init_random_q,
    "init_kmeans": init_kmeans_q,
    "init_streaming_kmeans": init_streaming_kmeans_q,
    "online_run": online_run_q,
    "online_totals": online_totals_q,
    "stream_totals": stream_totals_q,
    "milestone_centers": milestone_centers_q,
    "online_horizon": online_horizon_q,
    "snapshot_order": snapshot_order_q,
    "snapshot_live": snapshot_live_q,
    "snapshot_pair": snapshot_pair_q,
    "lineage_match": lineage_match_q,
    "horizon_subtract": horizon_subtract_q,
    "snapshot_roundtrip": snapshot_roundtrip_q,
    "snapshot_text": snapshot_text_q,
    "horizon_sweep": horizon_sweep_q,
    "macro_centers": macro_centers_q,
    "macro_weights": macro_weights_q,
    "weighted_sample": weighted_sample_q,
    "weighted_draws": weighted_draws_q,
    "drawn_kmeans": drawn_kmeans_q,
    "macro_kmeans": macro_kmeans_q,
    "sampled_kmeans": sampled_kmeans_q,
    "centers_csv": centers_csv_q,
    "micro_macro": micro_macro_q,
    "kmeans_wssse": kmeans_wssse_q,
    "kmeans_train": kmeans_train_q,
    "lineage_members": lineage_members_q,
    "streaming_kmeans": streaming_kmeans_q,
}
