"""Shared building blocks of the registered queries (Spark side).

Every plan reads the test tables (or data Spark derives from them); seeds
are the first q points by id (a top-q, never a global sort of the table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.assign import assign, collect_view
from ..operators.features import cf_aggregate, cf_apply, empty_state, refresh
from ..sources.tables import embedding_points, event_points

# Fixed parameters of the registered queries.
EMB_Q = 10  # micro-clusters seeded from the first 10 embeddings
MANY_Q = 1000  # micro-clusters seeded from the first 1,000 events, for the center index
EV_Q = 12  # micro-clusters seeded from the first 12 events
EV_SPLIT = 20  # events before day 20 build the state, later days are the batch
T_FACTOR = 2.0
M_LAST = 20
DELTA_DAYS = 5
DELTA_HOURS = 100


def seeds(points: DataFrame, q: int, x: str = "x") -> DataFrame:
    """``slot, center``: the first q points by id (slot = rank - 1)."""
    first = points.select("id", x).orderBy("id").limit(q)
    return first.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("slot"), F.col(x).alias("center"))


def state_from(points: DataFrame, centers: DataFrame, dim: int, tick: str | None) -> DataFrame:
    """Seeded empty state + one batch of points (all inside), refreshed."""
    spark = points.sparkSession
    st0 = empty_state(spark, centers, dim, "center")
    view = collect_view(st0)
    sums = cf_aggregate(assign(points, view), dim, "x", tick)
    return refresh(cf_apply(st0, sums))


def emb_state(spark: SparkSession, sf: str, q: int = EMB_Q) -> DataFrame:
    pts = embedding_points(spark, sf)
    return state_from(pts, seeds(pts, q), 64, None)


def ev_points(spark: SparkSession, sf: str) -> DataFrame:
    return event_points(spark, sf, 86400)


def ev_state(spark: SparkSession, sf: str, q: int = EV_Q, split: int = EV_SPLIT) -> DataFrame:
    """State over days < split, seeded with the first q events."""
    pts = ev_points(spark, sf)
    return state_from(pts.where(F.col("tick") < split), seeds(pts, q), 2, "tick")


def user_snapshot_at(spark: SparkSession, sf: str, tc, ticks: DataFrame | None = None) -> DataFrame:
    """Snapshot-shaped table derived from ``events``: at clock tc one
    micro-cluster per user holding the CF of its events with day < tc;
    slot = user_id, ids = [user_id]. With ``ticks`` (column ``tick``) one
    snapshot per listed clock (a range join of events against the ticks)."""
    pts = ev_points(spark, sf)
    if ticks is None:
        ticks = spark.range(1).select(F.lit(int(tc)).cast("long").alias("tick"))
    # pre-aggregate per (user, day) before the range join with the clocks:
    # the join then sees users x days rows, not every event once per clock
    daily = pts.groupBy("user_id", "tick").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x")[0]).alias("s0"),
        F.sum(F.col("x")[1]).alias("s1"),
        F.sum(F.col("x")[0] * F.col("x")[0]).alias("q0"),
        F.sum(F.col("x")[1] * F.col("x")[1]).alias("q1"),
    )
    j = daily.join(F.broadcast(ticks.select(F.col("tick").alias("clock"))), F.col("tick") < F.col("clock"))
    sums = j.groupBy("clock", "user_id").agg(
        F.sum("n").alias("n"),
        F.array(F.sum("s0"), F.sum("s1")).alias("cf1x"),
        F.array(F.sum("q0"), F.sum("q1")).alias("cf2x"),
        F.sum(F.col("tick") * F.col("n")).alias("cf1t"),
        F.sum(F.col("tick") * F.col("tick") * F.col("n")).alias("cf2t"),
    )
    return sums.select(
        F.col("clock").alias("tick"),
        F.col("user_id").cast("int").alias("slot"),
        F.array(F.col("user_id")).alias("ids"),
        "n", "cf1x", "cf2x", "cf1t", "cf2t",
    )


def pair_snapshot_at(spark: SparkSession, sf: str, tc: int) -> DataFrame:
    """As ``user_snapshot_at`` but users merged in pairs (slot = user_id div
    2, ids = both users): lineage with merges."""
    u = user_snapshot_at(spark, sf, tc)
    return u.groupBy(F.floor(F.col("slot") / 2).cast("int").alias("slot")).agg(
        F.sum("n").alias("n"),
        F.array(F.sum(F.col("cf1x")[0]), F.sum(F.col("cf1x")[1])).alias("cf1x"),
        F.array(F.sum(F.col("cf2x")[0]), F.sum(F.col("cf2x")[1])).alias("cf2x"),
        F.sum("cf1t").alias("cf1t"),
        F.sum("cf2t").alias("cf2t"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"),
    )


def r(c, d: int = 6):
    """Rounded double column (the oracle rounds the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, d)
