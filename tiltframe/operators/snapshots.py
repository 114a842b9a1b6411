"""Pyramidal time frame: snapshot order, retention, storage, pairing,
horizon subtraction and text export.

Snapshots are one Parquet table partitioned by ``tick``; a snapshot at
clock ``tc`` holds the state after ``tc`` ticks (ticks 0..tc-1). Reading a
snapshot is partition pruning, and the (tc, h) -> (t1, t2) lookup is an
as-of join against the small table of live ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import vsub
from ..params import STATE_SCHEMA, SnapshotParams
from .lineage import members, related

# The text layout of an exported micro-cluster block.
BLOCK_RULE = "=========================================================== "
LABEL_IDS = "MicroCluster IDs = "
LABEL_CF2X = "CF2X = "
LABEL_CF1X = "CF1X = "
LABEL_CF2T = "CF2T = "
LABEL_CF1T = "CF1T = "
LABEL_N = "N = "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order_of(tc, alpha: int) -> Column:
    """Snapshot order of clock ``tc``: the largest i with tc mod alpha^i = 0
    (integer arithmetic; null for tc < 1)."""
    t = _c(tc).cast("long")
    powers = F.filter(
        F.sequence(F.lit(1), F.lit(62)),
        lambda i: (F.pow(F.lit(float(alpha)), i) <= t.cast("double"))
        & ((t % F.pow(F.lit(float(alpha)), i).cast("long")) == 0),
    )
    return F.when(t >= 1, F.size(powers))


def expiry_of(tc, alpha: int, l: int) -> Column:
    """Clock at which the snapshot of ``tc`` is dropped:
    tc + (alpha^l + 1) * alpha^(order + 1)."""
    span = (alpha**l + 1) * F.pow(F.lit(float(alpha)), order_of(tc, alpha) + 1).cast("long")
    return _c(tc).cast("long") + span


def is_live(tick, now, alpha: int, l: int) -> Column:
    """Closed form of the retention rule: the snapshot of ``tick`` still
    exists at clock ``now``."""
    n = now if isinstance(now, Column) else F.lit(int(now))
    return (_c(tick) >= 1) & (_c(tick) <= n) & (expiry_of(tick, alpha, l) > n)


def schedule(spark: SparkSession, last_clock: int | DataFrame, p: SnapshotParams) -> DataFrame:
    """For every clock 1..T: its order and whether it is live at T.

    ``last_clock`` may be a one-row DataFrame with column ``T`` (derived
    from data), so the range grows with the data it describes."""
    if isinstance(last_clock, DataFrame):
        base = last_clock.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("T").cast("long"))).alias("tick"), F.col("T"))
    else:
        base = spark.range(1, int(last_clock) + 1).select(F.col("id").alias("tick"), F.lit(int(last_clock)).cast("long").alias("T"))
    return base.select(
        "tick",
        order_of("tick", p.alpha).alias("snap_order"),
        is_live("tick", F.col("T"), p.alpha, p.l).alias("live"),
    )


def save_snapshot(spark: SparkSession, state: DataFrame, path: str, tc: int, p: SnapshotParams) -> None:
    """Write the state as partition ``tick=tc`` (overwrite: idempotent on
    replay) and drop the partition that expires at ``tc``."""
    if tc < 1:
        return
    state.select(*STATE_SCHEMA.fieldNames()).coalesce(1).write.mode("overwrite").parquet(f"{path}/tick={tc}")
    expire(spark, path, tc, p)


def expire(spark: SparkSession, path: str, tc: int, p: SnapshotParams) -> None:
    """Drop the snapshot partition that leaves the time frame at clock tc:
    tc - (alpha^l + 1) * alpha^(order(tc) + 1), when positive."""
    if tc < 1:
        return
    order = 0
    while tc % (p.alpha ** (order + 1)) == 0:
        order += 1
    bye = tc - (p.alpha**p.l + 1) * p.alpha ** (order + 1)
    if bye > 0:
        jvm = spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(f"{path}/tick={bye}")
        fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hp):
            fs.delete(hp, True)


def expire_all(spark: SparkSession, path: str, now: int, p: SnapshotParams) -> list[int]:
    """Maintenance: drop every tick partition that is not live at clock
    ``now`` (closed form of the retention rule). Needed after empty ticks,
    when the per-write rule had no write to hang the expiry on. Returns the
    dropped ticks. Works on the partition listing only."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if not (st.isDirectory() and name.startswith("tick=")):
            continue
        t = int(name.split("=", 1)[1])
        order = 0
        while t >= 1 and t % (p.alpha ** (order + 1)) == 0:
            order += 1
        live = 1 <= t <= now and t + (p.alpha**p.l + 1) * p.alpha ** (order + 1) > now
        if not live and t != now:
            fs.delete(st.getPath(), True)
            dropped.append(t)
    return sorted(dropped)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot table (``tick`` partition column + state columns); an
    empty table when nothing was saved yet."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
        from pyspark.sql import types as T

        return spark.createDataFrame([], T.StructType([T.StructField("tick", T.LongType())] + list(STATE_SCHEMA.fields)))
    return spark.read.parquet(path)


def snapshot_at(snapshots: DataFrame, tick: int) -> DataFrame:
    """One snapshot (partition pruning on ``tick``)."""
    return snapshots.where(F.col("tick") == F.lit(int(tick)))


def live_ticks(snapshots: DataFrame, now=None, p: SnapshotParams | None = None) -> DataFrame:
    """Distinct ticks present in the snapshot table (partition listing);
    with ``now`` and ``p`` only those the retention rule keeps at ``now``."""
    t = snapshots.select("tick").distinct()
    if now is not None and p is not None:
        t = t.where(is_live("tick", now, p.alpha, p.l))
    return t


def snapshot_pairs(requests: DataFrame, ticks: DataFrame) -> DataFrame:
    """As-of lookup of (t1, t2) for each request (tc, h).

    t1 = latest snapshot <= tc (-1 if none); t2 = latest snapshot <= t1 - h,
    or the earliest snapshot when there is none; (-1, -1) without t1.
    The live ticks are few by construction ((alpha - 1)(alpha^l + 1) per
    order, log_alpha T orders), so they travel as ONE broadcast row holding
    the sorted tick array; each request is answered in place (no shuffle of
    the requests, no request x tick rows).
    """
    arr = ticks.agg(F.array_sort(F.collect_set(F.col("tick").cast("long"))).alias("_tk"))
    r = requests.select(F.col("tc").cast("long").alias("tc"), F.col("h").cast("long").alias("h")).dropDuplicates(["tc", "h"])
    j = r.crossJoin(F.broadcast(arr))
    t1 = F.expr("array_max(filter(_tk, t -> t <= tc))")
    j = j.select("tc", "h", "_tk", t1.alias("_t1"))
    t2 = F.expr("coalesce(array_max(filter(_tk, t -> t <= _t1 - h)), element_at(_tk, 1))")
    return j.select(
        "tc",
        "h",
        F.coalesce(F.col("_t1"), F.lit(-1).cast("long")).alias("t1"),
        F.when(F.col("_t1").isNull(), F.lit(-1).cast("long")).otherwise(t2).alias("t2"),
    )


def lineage_match(s1: DataFrame, s2: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pairs (slot1, slot2) of two snapshots sharing at least one id
    (equi-join on the exploded ids, then distinct)."""
    key = key or []
    a = s1.select(*key, F.col("slot").alias("slot1"), F.explode("ids").alias("_id"))
    b = s2.select(*key, F.col("slot").alias("slot2"), F.explode("ids").alias("_id"))
    return a.join(b, key + ["_id"]).select(*key, "slot1", "slot2").distinct()


def _sums_of_related(rel: DataFrame, s2: DataFrame, key: list[str]) -> DataFrame:
    """Per slot1 the element-wise sums of the related micro-clusters' CFs (one
    row per vector entry and micro-cluster; no list of vectors)."""
    b = s2.select(*key, F.col("slot").alias("slot2"), "ids", "n", "cf1t", "cf2t", F.posexplode(F.arrays_zip("cf1x", "cf2x")).alias("pos", "v"))
    each = rel.join(b, key + ["slot2"]).groupBy(*key, "slot1", "pos").agg(
        F.sum("n").alias("_n2"), F.sum("cf1t").alias("_t12"), F.sum("cf2t").alias("_t22"),
        F.sum("v.cf1x").alias("_a"), F.sum("v.cf2x").alias("_b"),
    )
    per = each.groupBy(*key, "slot1").agg(
        F.max("_n2").alias("_n2"), F.max("_t12").alias("_t12"), F.max("_t22").alias("_t22"),
        F.sort_array(F.collect_list(F.struct("pos", "_a", "_b"))).alias("_v"),  # one entry a dimension
    )
    return per.select(*key, "slot1", "_n2", "_t12", "_t22", F.col("_v._a").alias("_c12"), F.col("_v._b").alias("_c22"))


def horizon_subtract(s1: DataFrame, s2: DataFrame, h, t1, t2, key: list[str] | None = None, log: DataFrame | None = None) -> DataFrame:
    """Micro-clusters of the horizon: each t1 micro-cluster minus all t2
    micro-clusters related to it by lineage; kept whole when nothing is
    related, or when t1 - h < t2 (the horizon reaches before the older
    snapshot; flagged ``horizon_exact = false``).

    ``h``, ``t1``, ``t2`` are column names of ``s1`` (per request) or ints.
    With a merge ``log`` (see ``lineage``) the relation comes from it, the
    snapshots hold each micro-cluster's primary id and ``ids`` stays that of
    the newer snapshot (``horizon_members`` lists the ids gained). Without one
    the snapshots hold whole ids lists, and the older ids are taken out.
    """
    key = key or []
    # fresh attribute ids: both sides may derive from the same request plan
    s1 = s1.select(*[F.col(c).alias(c) for c in s1.columns])
    s2 = s2.select(*[F.col(c).alias(c) for c in s2.columns])
    lit = lambda v: s1[v] if isinstance(v, str) else F.lit(v)
    if log is None:
        rel = lineage_match(s1, s2, key)
    else:
        at = lambda v: F.col(v) if isinstance(v, str) else F.lit(v).cast("long")
        rel = related(s1, s2.withColumn("_at1", at(t1)).withColumn("_at2", at(t2)), log, "_at1", "_at2", key)
    sub = _sums_of_related(rel, s2, key)
    if log is None:
        gone = rel.join(s2.select(*key, F.col("slot").alias("slot2"), F.explode("ids").alias("_id")), key + ["slot2"])
        sub = sub.join(gone.groupBy(*key, "slot1").agg(F.collect_set("_id").alias("_ids2")), key + ["slot1"], "left")
    sub = sub.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[c for c in sub.columns if c not in key])
    cond = [s1[k] == F.col(f"_key_{k}") for k in key] + [s1["slot"] == sub["slot1"]]
    j = s1.join(sub, cond, "left")
    exact = (lit(t1) - lit(h)) >= lit(t2)
    do = F.col("_n2").isNotNull() & exact
    ids = s1["ids"] if log is not None else F.when(do & F.col("_ids2").isNotNull(), F.array_except(s1["ids"], F.col("_ids2"))).otherwise(s1["ids"])
    cols = [s1[k] for k in key] + [
        s1["slot"],
        ids.alias("ids"),
        F.when(do, s1["n"] - F.col("_n2")).otherwise(s1["n"]).alias("n"),
        F.when(do, vsub("cf1x", "_c12")).otherwise(s1["cf1x"]).alias("cf1x"),
        F.when(do, vsub("cf2x", "_c22")).otherwise(s1["cf2x"]).alias("cf2x"),
        F.when(do, s1["cf1t"] - F.col("_t12")).otherwise(s1["cf1t"]).alias("cf1t"),
        F.when(do, s1["cf2t"] - F.col("_t22")).otherwise(s1["cf2t"]).alias("cf2t"),
        exact.alias("horizon_exact"),
    ]
    return j.select(*cols)


def horizon_members(s1: DataFrame, s2: DataFrame, log: DataFrame, t1: int, t2: int) -> DataFrame:
    """(slot, pos, id): the ids that the micro-clusters of snapshot ``s1`` (tick
    t1) gained since snapshot ``s2`` (tick t2), as rows."""
    upto = lambda t: log.where(F.col("tick") <= F.lit(int(t)))
    old = members(s2, upto(t2)).select("id")
    return members(s1, upto(t1)).join(old, "id", "left_anti").select("slot", "pos", "id")


def horizon_clusters(snapshots: DataFrame, requests: DataFrame, ticks: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """For every request (tc, h): its pair (t1, t2) and the horizon's
    micro-clusters, all requests in one plan (keys tc, h). ``ticks``: the
    snapshot ticks when the caller has them (default: listed from the
    table's partitions). ``log``: the merge log of the snapshots' model."""
    # the request list is not size-bounded: no broadcast hint, AQE decides
    pairs = snapshot_pairs(requests, live_ticks(snapshots) if ticks is None else ticks).where(F.col("t1") >= 0)
    s1 = snapshots.join(pairs, snapshots["tick"] == pairs["t1"]).drop("tick")
    s2 = snapshots.join(pairs.select("tc", "h", "t1", "t2"), snapshots["tick"] == F.col("t2")).drop("tick")
    return horizon_subtract(s1, s2, "h", "t1", "t2", ["tc", "h"], log).join(pairs, ["tc", "h"])


def _fmt_vec(c, fmt: str | None) -> Column:
    el = (lambda v: F.format_string(fmt, v)) if fmt else (lambda v: v.cast("string"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, el), ","), F.lit("]"))


def snapshot_text(snapshots: DataFrame, limit: int | None = None, fmt: str | None = None) -> DataFrame:
    """Text block per micro-cluster of every snapshot with tick <= limit.
    Doubles print as Spark casts them, or with ``fmt`` (e.g. '%.4f')."""
    s = snapshots if limit is None else snapshots.where(F.col("tick") <= F.lit(int(limit)))
    nl = F.lit("\n")
    text = F.concat(
        F.lit(BLOCK_RULE), nl,
        F.lit(LABEL_IDS), F.concat(F.lit("["), F.array_join(F.transform("ids", lambda v: v.cast("string")), ","), F.lit("]")), nl,
        F.lit(LABEL_CF2X), _fmt_vec("cf2x", fmt), nl,
        F.lit(LABEL_CF1X), _fmt_vec("cf1x", fmt), nl,
        F.lit(LABEL_CF2T), F.col("cf2t").cast("string"), nl,
        F.lit(LABEL_CF1T), F.col("cf1t").cast("string"), nl,
        F.lit(LABEL_N), F.col("n").cast("string"), nl,
    )
    return s.select("tick", "slot", text.alias("text"))


def export_text(snapshots: DataFrame, out_dir: str, limit: int | None = None, fmt: str | None = None) -> None:
    """One text folder per snapshot tick."""
    snapshot_text(snapshots, limit, fmt).repartition("tick").sortWithinPartitions("tick", "slot").select("tick", "text").write.mode("overwrite").partitionBy("tick").text(out_dir)
