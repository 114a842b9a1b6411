"""Online phase: fold batches of points into q micro-clusters.

``OnlineClusterer.step(batch, tick)`` runs one batch; it is what
``foreachBatch`` calls for a stream, and it can be called in a loop over a
batch table. Every step writes the new state as a versioned Parquet table in
the shared folder (lineage is cut there) and its merges to the merge log.

A batch is committed by its manifest, one small file that is renamed into
place after everything the batch writes is there: state, merges and the
milestone's centers in the sink. What has no manifest did not happen: a
restarted driver resumes from the last manifest, and a replayed batch either
has one (skipped) or is done again, each of its parts overwriting its own
folder. Snapshots leave the time frame only after that.

Per step, data-sized work is one narrow Arrow pass (assignment + inside /
outlier split + per-batch partial CF sums; broken rows are counted in it) and
one small keyed aggregate; everything else touches q rows, and the outliers as
one sorted stream (``operators.maintain``).

No point is dropped without a trace: points without a tick, with a broken
vector, or older than the clock are kept with a reason (``rejects``). In event
mode a tick is folded once a newer one (by ``lateness`` ticks) has been seen,
so a tick that spans triggers is folded whole; until then its points wait in
the shared folder.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assign import CenterView, collect_view
from ..operators.features import assign_and_summarize, cf_merge_partials, empty_state
from ..operators.kmeans import kmeans_parallel, lloyd, random_gaussian_model, random_uniform_centers, streaming_kmeans_update
from ..operators.lineage import LOG_SCHEMA, empty_log, with_members
from ..operators.macro import append_centers, centers_and_weights, macro_kmeans, sampled_macro_kmeans
from ..operators.maintain import COUNT_FIELDS, update_state
from ..operators import snapshots as snaps
from ..params import STATE_SCHEMA, OnlineParams, SnapshotParams
from ..session import new_run_dir, path_exists


def _delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and rename it into place."""
    jvm = spark.sparkContext._jvm
    final, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(part, final):
        raise OSError(f"cannot commit {path}")


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("tick", T.LongType()),  # clock after the batch
        T.StructField("n_batch", T.LongType()),
        T.StructField("n_total", T.LongType()),
        T.StructField("initialized", T.BooleanType()),
        T.StructField("marks", T.ArrayType(T.LongType())),  # milestones reached by it
    ]
)
_STORED = T.StructType([*STATE_SCHEMA.fields, *COUNT_FIELDS])


class Milestones:
    """When the running total falls in (mark - band, mark + band] after a
    batch: macro-cluster the last ``horizon`` ticks into ``k`` clusters. The
    centers are kept with the model (``milestone_centers``) and, when ``sink`` is
    given, written there as CSV lines, one folder a batch, before the batch is
    committed: each milestone is there exactly once, whatever fails.
    ``num_points``: on that many weighted draws."""

    def __init__(self, marks, band: int = 100, horizon: int = 256, k: int = 5, sink: str | None = None, num_points: int | None = None):
        self.marks, self.band, self.horizon, self.k, self.sink, self.num_points = list(marks), band, horizon, k, sink, num_points


class OnlineClusterer:
    """State table: ``<base>/table/kind=state/tick=<clock>``, one partition per
    non-empty batch (q rows); merge log: ``<base>/table/kind=merge``, appended
    to by the same write; manifests: ``<base>/manifest``. With a snapshot
    schedule the state table IS the snapshot table: partitions that leave the
    pyramidal time frame are dropped after each commit; without one only the
    last two versions are kept. ``seeds`` (slot, center): centers of the random
    start."""

    def __init__(
        self,
        spark: SparkSession,
        params: OnlineParams,
        base_dir: str | None = None,
        snapshot: SnapshotParams | None = None,
        x: str = "x",
        order: str = "id",
        milestones: "Milestones | None" = None,
        seeds: DataFrame | None = None,
    ):
        self.spark = spark
        self.milestones = milestones
        self.p = params
        self.base = base_dir or new_run_dir(spark, "online")
        self.snapshot = snapshot
        self.x = x
        self.order = order
        self.seeds = seeds
        self.time = 0  # clock: ticks seen, empty ones included
        self.total = 0  # points seen
        self.initialized = False
        self.version = -1  # clock value of the last committed state
        self.progress: list[tuple[int, int, int]] = []
        self._skm = None  # streaming k-means start model (slots, centers, weights)
        self._new_skm = None  # that of the batch at work
        self._view: CenterView | None = None  # centers and radii of the last committed state
        self._new_view: CenterView | None = None
        self._before = -1  # version before the last one
        self._resume()

    # -- storage ----------------------------------------------------------
    @property
    def state_path(self) -> str:
        return f"{self.base}/table/kind=state"

    @property
    def snapshot_path(self) -> str:
        return self.state_path

    def _state_version_path(self, v: int) -> str:
        return f"{self.state_path}/tick={v}"

    def manifests(self) -> DataFrame:
        """One row per committed batch."""
        path = f"{self.base}/manifest"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).option("pathGlobFilter", "*.json").json(path)

    def _resume(self) -> None:
        """Pick up after the last committed batch (restart after a failure)."""
        done = self.manifests().orderBy("tick").collect()  # one row a batch
        if not done:
            return
        last = done[-1]
        self.time, self.total, self.initialized = int(last["tick"]), int(last["n_total"]), bool(last["initialized"])
        self.progress = [(int(r["tick"]), int(r["n_batch"]), int(r["n_total"])) for r in done]
        if self.initialized:
            self.version = self.time
            with_state = [r["tick"] for r in done if r["initialized"]]
            self._before = int(with_state[-2]) if len(with_state) > 1 else -1
        elif path_exists(self.spark, f"{self.base}/skm/version={self.time}"):
            rows = self.spark.read.parquet(f"{self.base}/skm/version={self.time}").collect()  # k rows
            self._skm = _rows_to_model(sorted(rows, key=lambda r: r["slot"]))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(self._state_version_path(self.version))

    def state(self, whole_ids: bool = False) -> DataFrame:
        """Current micro-clusters (ON19). ``ids`` holds the primary id and the
        last one of the list; with ``whole_ids`` the whole list, from the merge
        log (for reports: ``lineage.members`` gives it as rows)."""
        if not self.initialized:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        st = self._stored().select(*STATE_SCHEMA.fieldNames())
        return with_members(st, self.merges()) if whole_ids else st

    def states(self) -> DataFrame:
        """Every kept version (``tick`` + state columns)."""
        return self.spark.read.schema(_with_tick(_STORED)).parquet(self.state_path)

    def merges(self, upto: int | None = None) -> DataFrame:
        """The merge log (id, into, after, seq, tick) up to a clock value (that
        of the last committed batch)."""
        path = f"{self.base}/table/kind=merge"
        if not path_exists(self.spark, path):
            return empty_log(self.spark)
        log = self.spark.read.schema(LOG_SCHEMA).parquet(path)
        return log.where(F.col("tick") <= F.lit(int(self.version if upto is None else upto)))

    def progress_table(self) -> DataFrame:
        """One row per non-empty batch: clock after it, its size, total so far."""
        return self.manifests().select("tick", "n_batch", "n_total")

    def milestone_centers(self) -> DataFrame | None:
        """Centers of every milestone reached (mark, tick, n_total, cluster,
        weight, center); None before the first."""
        if not path_exists(self.spark, f"{self.base}/milestones"):
            return None
        reached = self.manifests().select("tick", "n_total", F.explode("marks").alias("mark"))
        return reached.join(self.spark.read.parquet(f"{self.base}/milestones"), "tick").select("mark", "tick", "n_total", "cluster", "weight", "center")

    def _write_state(self, step: DataFrame, version: int) -> None:
        # parts of an attempt that was not committed
        _delete_path(self.spark, f"{self.base}/table/kind=merge/tick={version}")
        _delete_path(self.spark, self._state_version_path(version))
        out = step.withColumn("tick", F.lit(version).cast("long"))
        out.write.mode("append").partitionBy("kind", "tick").parquet(f"{self.base}/table")

    def _write_milestone(self, version: int, total: int) -> list[int]:
        """Centers of the milestones that ``total`` reaches."""
        ms = self.milestones
        marks = [] if ms is None else [int(mk) for mk in ms.marks if mk - ms.band < total <= mk + ms.band]
        if marks:
            path = f"{self.base}/milestones/tick={version}"
            self.macro_at(version, ms.horizon, ms.k, num_points=ms.num_points).select("cluster", "weight", "center").coalesce(1).write.mode("overwrite").parquet(path)
            if ms.sink:
                append_centers(self.spark.read.parquet(path), ms.sink, batch=version)
        return marks

    def _commit(self, version: int, n_batch: int, initialized: bool) -> None:
        """End of a non-empty batch: milestone output, then the manifest."""
        total = self.total + n_batch
        marks = self._write_milestone(version, total) if initialized else []
        row = {"tick": version, "n_batch": n_batch, "n_total": total, "initialized": initialized, "marks": marks}
        _write_text(self.spark, f"{self.base}/manifest/{version:020d}.json", json.dumps(row))
        self.total, self.initialized = total, initialized
        self.progress.append((version, n_batch, total))
        if not initialized:
            self._skm = self._new_skm
            return
        old, self._before, self.version = self._before, self.version, version
        self._view, self._new_view = self._new_view, None
        if self.snapshot is not None:
            if self._before >= 0 and version - self._before > 1:
                # empty ticks since the last write: their expiries had no write
                snaps.expire_all(self.spark, self.state_path, version, self.snapshot)
            else:
                snaps.expire(self.spark, self.state_path, version, self.snapshot)
        elif old >= 0:
            _delete_path(self.spark, self._state_version_path(old))

    # -- one batch --------------------------------------------------------
    def step(self, batch: DataFrame, tick: int | None = None, checked: bool = False) -> None:
        """Process one batch; all its points carry time ``tick`` (default:
        the current clock). Ticks in between with no batch count as empty.
        ``checked``: the vectors are known to be whole."""
        if tick is not None:
            if tick == self.time - 1:
                return  # replay of the last batch: folded already
            if tick < self.time:
                raise ValueError(f"tick {tick} is older than the clock {self.time}: a new stream needs a new base_dir (or mode='event')")
            self.time = int(tick)
        now, version = self.time, self.time + 1
        if not checked:
            batch = batch.withColumn("_reason", self._reason())
            if not self.initialized:
                self._keep_broken(batch, now, None)
                batch = batch.where("_reason IS NULL")
        ident = F.col(self.order).cast("long") if self.order in batch.columns else F.monotonically_increasing_id()
        bad = [] if checked or not self.initialized else [F.col("_reason").isNotNull().alias("bad")]
        pts = batch.select(F.col(self.x).alias("x"), ident.alias("id"), F.lit(now).cast("long").alias("tick"), *bad)
        if self.initialized:
            n_batch = self._maintain(pts, now, version, batch)
            started = True
        else:
            n_batch, started = self._init(pts, now, version)
        if n_batch:
            self._commit(version, n_batch, started)
        self.time = version

    def _maintain(self, pts: DataFrame, now: int, version: int, batch: DataFrame) -> int:
        p = self.p
        st = self._stored()
        if self._view is None:
            self._view = collect_view(st)
        flagged = "bad" in pts.columns
        fused = assign_and_summarize(pts, self._view, p.t_factor, bad="bad" if flagged else None).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # one job: the pass, the sums, the outlier rule, the state
            sums = cf_merge_partials(fused.where("kind = 0").select("slot", "n", "cf1x", "cf2x", "cf1t", "cf2t"), p.dim)
            if flagged:
                sums = sums.unionByName(fused.where("kind = 2").select("slot", "n", "cf1x", "cf2x", "cf1t", "cf2t"))
            outliers = fused.where("kind = 1").select("seq_tick", "seq_id", "x")
            self._write_state(update_state(st, sums, outliers, p, now), version)
        finally:
            fused.unpersist()
        if not path_exists(self.spark, self._state_version_path(version)):
            return 0  # an empty batch
        done = self.spark.read.schema(_STORED).parquet(self._state_version_path(version)).select("slot", "centroid", "rmsd", "n_batch", "n_broken").collect()  # q rows
        if done[0]["n_broken"]:
            self._keep_broken(batch, now, done[0]["n_broken"])
        if not done[0]["n_batch"]:
            _delete_path(self.spark, self._state_version_path(version))
            return 0
        done.sort(key=lambda r: r["slot"])
        self._new_view = CenterView([r["slot"] for r in done], [r["centroid"] for r in done], [r["rmsd"] for r in done])
        return int(done[0]["n_batch"])

    # -- points that cannot be folded ----------------------------------------
    def _reason(self, tick=None):
        """Why a point cannot be folded now (null: it can)."""
        x = F.col(self.x)
        whole = x.isNotNull() & (F.size(x) == self.p.dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        out = F.when(~F.coalesce(whole, F.lit(False)), F.lit("broken_vector"))
        if tick is None:
            return out
        return F.when(tick.isNull(), F.lit("null_tick")).when(tick < self.time, F.lit("late")).otherwise(out)

    def _keep_broken(self, tagged: DataFrame, tick: int, known: int | None) -> None:
        """Write a batch's rows that have a reason; ``known``: how many there
        are (None: not counted yet)."""
        bad = tagged.where("_reason IS NOT NULL")
        if known or (known is None and not bad.isEmpty()):
            bad.write.mode("overwrite").parquet(f"{self.base}/rejects/source=step-{tick}")

    def rejects(self) -> DataFrame | None:
        """Every point that was not folded, with its ``reason``; None if there
        is none (yet)."""
        parts = []
        for name in ("rejects", "input", "pending"):
            path = f"{self.base}/{name}"
            if path_exists(self.spark, path):
                df = self.spark.read.option("mergeSchema", "true").parquet(path).where("_reason IS NOT NULL")
                parts.append(df.drop("source", "batch").withColumnRenamed("_reason", "reason"))
        out = None
        for df in parts:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    # -- initialisation routes -------------------------------------------
    def _build_from_centers(self, centers: DataFrame, pts: DataFrame, version: int, view: CenterView | None = None) -> None:
        """Seed q empty slots with the init centers, fold the batch in (every
        point inside) and refresh: the data pass + one bounded task."""
        st0 = empty_state(self.spark, centers, self.p.dim, "center")
        view = view if view is not None else collect_view(st0)
        fused = assign_and_summarize(pts, view, None)
        sums = cf_merge_partials(fused.where("kind = 0").select("slot", "n", "cf1x", "cf2x", "cf1t", "cf2t"), self.p.dim)
        self._write_state(update_state(st0, sums, None, self.p, version - 1), version)

    def _init(self, pts: DataFrame, now: int, version: int) -> tuple[int, bool]:
        """(points of the batch, whether the state is there now)."""
        p = self.p
        if p.min_init_points == 0 or p.init == "random":
            n_batch = pts.count()
            if n_batch == 0:
                return 0, False
            centers = self.seeds if self.seeds is not None else random_uniform_centers(self.spark, p.q, p.dim, p.seed)
            self._build_from_centers(centers.select("slot", "center"), pts, version)
            return n_batch, True
        if p.init == "kmeans":
            # a replayed batch overwrites its own folder
            mine = f"{self.base}/staging/version={version}"
            pts.write.mode("overwrite").parquet(mine)
            n_batch = self.spark.read.parquet(mine).count()
            start = n_batch > 0 and self.total + n_batch >= p.min_init_points
            if start:
                buf = self.spark.read.parquet(f"{self.base}/staging").where(F.col("version") <= version).drop("version")
                buf = buf.withColumn("tick", F.lit(now).cast("long"))
                run = f"{self.base}/start-{version}"
                centers = lloyd(buf, kmeans_parallel(buf, p.q, p.seed, folder=run), 10, 0.0, folder=run)
                centers = _pad_centers(self.spark, centers, p.q, p.dim)
                self._build_from_centers(centers, buf, version)
            return n_batch, start
        # streaming k-means route (default): the k-row model lives on the
        # driver between batches (bounded by q) and is persisted per version
        model = self._skm if self._skm is not None else random_gaussian_model(p.q, p.dim, p.seed, 0.0)
        out_path = f"{self.base}/skm/version={version}"
        streaming_kmeans_update(model, pts, 1.0, "batches", with_total=True).write.mode("overwrite").parquet(out_path)
        rows = sorted(self.spark.read.parquet(out_path).collect(), key=lambda r: r["slot"])
        n_batch = int(rows[0]["batch_points"]) if rows else 0
        if n_batch == 0:
            return 0, False
        self._new_skm = _rows_to_model(rows)
        if self.total < p.min_init_points:
            return n_batch, False
        slots, C, _ = self._new_skm
        centers = self.spark.createDataFrame(
            [(int(sl), [float(v) for v in c]) for sl, c in zip(slots, C)], "slot int, center array<double>"
        )
        self._build_from_centers(centers, pts, version, CenterView(slots, C, np.zeros(len(slots))))
        return n_batch, True

    # -- offline front door ---------------------------------------------------
    def macro_at(self, tc: int, h: int, k: int, max_iter: int = 20, num_points: int | None = None) -> DataFrame:
        """Macro-clusters of the last ``h`` ticks before ``tc`` (OFF6):
        snapshot pair, horizon subtraction, k-means over the horizon's
        micro-clusters: weighted, from the k heaviest, or with ``num_points``
        on that many weighted draws, from k further draws. Needs snapshots."""
        snaps_df = snaps.read_snapshots(self.spark, self.snapshot_path).select("tick", *STATE_SCHEMA.fieldNames()[:7])
        req = self.spark.createDataFrame([(int(tc), int(h))], "tc bigint, h bigint")
        # the merges of a batch at work are there, though not committed yet
        return self._macro(snaps.horizon_clusters(snaps_df, req, log=self.merges(max(int(tc), self.version))), ["tc", "h"], k, max_iter, num_points)

    def macro_now(self, k: int, max_iter: int = 20, num_points: int | None = None) -> DataFrame:
        """Macro-clusters of the current state (no snapshots needed)."""
        return self._macro(self.state(), [], k, max_iter, num_points)

    def _macro(self, mcs: DataFrame, key: list[str], k: int, max_iter: int, num_points: int | None) -> DataFrame:
        if num_points:
            return sampled_macro_kmeans(mcs, k, num_points, max_iter, self.p.seed, key)
        cw = centers_and_weights(mcs, key).withColumn("w", F.col("n").cast("double"))
        return macro_kmeans(cw, k, max_iter, 1e-4, key, "w")

    # -- drivers ------------------------------------------------------------
    def run_ticks(self, points: DataFrame, tick: str = "tick", last_tick: int | None = None, stage: bool = True) -> "OnlineClusterer":
        """Batch form of the stream: one step per tick value that occurs, in
        order (ticks in between only advance the clock).

        With ``stage`` the input is written once to the shared folder,
        partitioned by tick, so every step reads only its own partition
        (partition pruning) instead of rescanning the whole table per tick.
        Points that cannot be folded stay there with their reason.
        """
        tagged = points.withColumn("_reason", self._reason(F.col(tick)))
        if stage:
            path = f"{self.base}/input/source=run-{self.time}"
            # range partitioning on (tick, arrival key): balanced tasks, a
            # hot tick is split over several tasks, few files per tick
            keys = [tick] + ([self.order] if self.order in points.columns else [])
            tagged.repartitionByRange(*keys).write.mode("overwrite").partitionBy(tick).parquet(path)
            tagged = self.spark.read.parquet(path)
        good = tagged.where("_reason IS NULL").drop("_reason")
        there = sorted(int(r[0]) for r in good.select(tick).distinct().collect())
        for t in there:
            if last_tick is None or t <= last_tick:
                self.step(good.where(F.col(tick) == t), t, checked=True)
        self.time = max(self.time, (last_tick if last_tick is not None else max(there, default=-1)) + 1)
        return self

    def foreach_batch(self, mode: str = "batch", tick: str = "tick", lateness: int = 0):
        """Function for ``writeStream.foreachBatch``.

        mode "batch": tick = batch id. mode "event": points go by their
        event-time ``tick`` column. A trigger is first written to the shared
        folder with a reason for each point that cannot be folded (decided
        once: a replayed trigger finds its folder and changes nothing); then
        every waiting tick that is more than ``lateness`` ticks older than
        the newest one is folded. ``flush`` folds the rest.
        """

        def fn(df: DataFrame, batch_id: int) -> None:
            if mode == "batch":
                self.step(df, int(batch_id))
                return
            mine = f"{self.base}/pending/batch={int(batch_id)}"
            if not path_exists(self.spark, f"{mine}/_SUCCESS"):
                df.withColumn("_reason", self._reason(F.col(tick))).write.mode("overwrite").parquet(mine)
            self._fold_waiting(tick, lateness, int(batch_id))

        return fn

    def flush(self, tick: str = "tick") -> "OnlineClusterer":
        """Fold every point that still waits for its tick to be complete (at
        the end of a stream)."""
        if path_exists(self.spark, f"{self.base}/pending"):
            self._fold_waiting(tick, None, None)
        return self

    def _fold_waiting(self, tick: str, lateness: int | None, batch_id: int | None) -> None:
        waiting = self.spark.read.parquet(f"{self.base}/pending")
        seen = waiting.groupBy("batch", F.col(tick).alias("t"), F.col("_reason").isNull().alias("good")).count().collect()
        ticks = sorted({int(r["t"]) for r in seen if r["good"] and r["t"] >= self.time})
        newest = max(ticks, default=None)
        good = waiting.where("_reason IS NULL").drop("_reason", "batch")
        for t in ticks:
            if lateness is None or t < newest - lateness:
                self.step(good.where(F.col(tick) == t), t, checked=True)
        # folders of earlier triggers with nothing left to fold
        for b in sorted({int(r["batch"]) for r in seen}):
            mine = [r for r in seen if r["batch"] == b]
            if batch_id is None or b >= batch_id or any(r["good"] and r["t"] >= self.time for r in mine):
                continue
            if not all(r["good"] for r in mine):
                gone = waiting.where((F.col("batch") == b) & F.col("_reason").isNotNull()).drop("batch")
                gone.write.mode("overwrite").parquet(f"{self.base}/rejects/source=batch-{b}")
            _delete_path(self.spark, f"{self.base}/pending/batch={b}")

    def start(self, stream: DataFrame, checkpoint: str | None = None, mode: str = "batch", trigger: dict | None = None, **kw):
        """Run on a streaming DataFrame (Structured Streaming, foreachBatch)."""
        w = stream.writeStream.foreachBatch(self.foreach_batch(mode, **kw)).option(
            "checkpointLocation", checkpoint or f"{self.base}/_stream_checkpoint"
        )
        if trigger:
            w = w.trigger(**trigger)
        return w.start()


def _with_tick(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("tick", T.LongType())])


def _rows_to_model(rows) -> tuple:
    return (
        np.array([r["slot"] for r in rows], dtype=np.int32),
        np.array([r["center"] for r in rows], dtype=np.float64),
        np.array([r["weight"] for r in rows], dtype=np.float64),
    )


def _pad_centers(spark, centers: DataFrame, q: int, dim: int) -> DataFrame:
    """Fewer centers than q: the remaining slots start at the zero vector."""
    have = centers.count()
    if have >= q:
        return centers
    zero = spark.range(have, q).select(
        F.col("id").cast("int").alias("slot"), F.array_repeat(F.lit(0.0), dim).alias("center")
    )
    return centers.unionByName(zero)


__all__ = ["OnlineClusterer", "Milestones"]
