"""Lineage of micro-clusters as an append-only merge log.

A merge is one row (id, into, after, seq) under its tick: the micro-cluster
with primary id ``id`` went into the one with primary id ``into``, whose list
of ids ended with ``after`` then. State rows keep two ids at most, whatever
happened before; what was merged into what by a tick comes from the log:

* ``jumps`` doubles the pointers id -> into: table k leads 2^k merges on, with
  the tick of the last of them. Ticks do not fall along a chain, so
  ``roots_at`` finds the micro-cluster that an id is part of at any tick by one
  join per table, largest first: log2(longest chain) joins for any number of
  requests.
* ``members`` lists all ids of each micro-cluster at a tick in list order: the
  merges concatenate lists, ``after`` is each id's predecessor, and doubling
  those pointers gives each id its list and its place in it.

All steps are keyed joins of log rows; each doubling is a table in the shared
folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_run_dir

MERGE_FIELDS = [T.StructField(c, T.LongType()) for c in ("id", "into", "after", "seq")]
LOG_SCHEMA = T.StructType([*MERGE_FIELDS, T.StructField("tick", T.LongType())])


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def _keep(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def jumps(log: DataFrame, folder: str | None = None) -> list[DataFrame]:
    """Tables (id, into, tick) leading 1, 2, 4, ... merges on, as long as
    there are chains that long."""
    folder = folder or new_run_dir(log.sparkSession, "lineage")
    out = [_keep(log.select("id", "into", "tick"), f"{folder}/jump-0")]
    while not out[-1].isEmpty():
        a = out[-1]
        b = a.select(F.col("id").alias("into"), F.col("into").alias("_into"), F.col("tick").alias("_tick"))
        out.append(_keep(a.join(b, "into").select("id", F.col("_into").alias("into"), F.col("_tick").alias("tick")), f"{folder}/jump-{len(out)}"))
    return out[:-1]


def roots_at(asked: DataFrame, tables: list[DataFrame], at: str, ident: str = "id") -> DataFrame:
    """``asked`` with ``root``: the primary id that column ``ident`` is part of
    at the tick in column ``at`` (itself if it was not merged by then)."""
    out = asked.withColumn("root", F.col(ident))
    for t in reversed(tables):
        step = t.select(F.col("id").alias("root"), F.col("into").alias("_into"), F.col("tick").alias("_tick"))
        out = out.join(step, "root", "left").withColumn("root", F.when(F.col("_tick") <= F.col(at), F.col("_into")).otherwise(F.col("root"))).drop("_into", "_tick")
    return out


def members(state: DataFrame, log: DataFrame, folder: str | None = None) -> DataFrame:
    """(slot, pos, id): every id of each micro-cluster of ``state`` in list
    order; ``log``: the merges up to the state's tick. Lists of micro-clusters
    that are gone (their slot was taken by an outlier) are left out."""
    folder = folder or new_run_dir(log.sparkSession, "members")
    chain = _keep(log.select("id", F.col("after").alias("head"), F.lit(1).cast("long").alias("pos")), f"{folder}/chain-0")
    k, open_ = 0, True
    while open_:
        ahead = chain.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("pos").alias("_pos"))
        k += 1
        step = _keep(
            chain.join(ahead, "head", "left").select("id", F.coalesce("_head", "head").alias("head"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"), F.col("_head").isNotNull().alias("moved")),
            f"{folder}/chain-{k}",
        )
        open_ = not step.where("moved").isEmpty()
        chain = step.drop("moved")
    own = state.where(F.size("ids") > 0).select("slot", F.col("ids")[0].alias("head"))
    first = own.select("slot", F.lit(0).cast("long").alias("pos"), F.col("head").alias("id"))
    return first.unionByName(own.join(chain, "head").select("slot", "pos", "id"))


def with_members(state: DataFrame, log: DataFrame) -> DataFrame:
    """``state`` with its ids listed whole: for a report of few micro-clusters
    with short lists; ``members`` gives the same as rows."""
    lists = members(state, log).groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_l"))
    whole = F.coalesce(F.col("_l.id"), F.col("ids"))
    return state.join(lists, "slot", "left").select(*(whole.alias(c) if c == "ids" else F.col(c) for c in state.columns))


def related(s1: DataFrame, s2: DataFrame, log: DataFrame, t1: str, t2: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Pairs (slot1, slot2): the micro-cluster of the newer snapshot ``s1`` that
    each one of the older ``s2`` is part of at the tick in ``s2``'s column
    ``t1``. A micro-cluster goes into at most one other, so the two share an id
    exactly if the older one's primary id is part of the newer one by then.
    With ``t2`` (a column) merges up to that tick, which are in ``s2``
    already, are not read."""
    key = key or []
    if t2 is not None:
        low, high = s2.agg(F.min(t2), F.max(t1)).first()
        if low is None:
            low = high = 0
        log = log.where((F.col("tick") > F.lit(low)) & (F.col("tick") <= F.lit(high)))
    old = s2.where(F.size("ids") > 0).select(*key, F.col("slot").alias("slot2"), F.col("ids")[0].alias("_id"), F.col(t1).alias("_at"))
    old = roots_at(old, jumps(log), "_at", "_id").select(*key, "slot2", F.col("root").alias("_id"))
    new = s1.where(F.size("ids") > 0).select(*key, F.col("slot").alias("slot1"), F.col("ids")[0].alias("_id"))
    return new.join(old, [*key, "_id"]).select(*key, "slot1", "slot2")
