"""Point views over the test tables.

Each view returns ``id BIGINT, x ARRAY<DOUBLE>`` plus what the table has
(``tick``, ``label``). Only the columns a view needs are read, so Parquet
column pruning applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: event-time origin of the ``events`` table (its first day).
EVENTS_ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_tick(ts_col: str = "ts", interval_seconds: int = 86400, origin: str = EVENTS_ORIGIN):
    """floor((ts - origin) / interval) as BIGINT, on wall-clock values
    (TIMESTAMP_NTZ arithmetic: independent of the session time zone)."""
    diff = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{origin}', CAST(`{ts_col}` AS TIMESTAMP_NTZ))")
    return F.floor(diff / F.lit(float(interval_seconds * 1_000_000))).cast("long")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-d float embeddings as double vectors; ``label`` 0-9."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        F.col("label"),
    )


def event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that are no points: (event_id, reason)."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    reason = F.when(F.col("value").isNull(), "null_value").when(k.isNull(), "null_k")
    return ev.select("event_id", reason.alias("reason")).where("reason IS NOT NULL")


def event_points(spark: SparkSession, sf_dir: str, interval_seconds: int = 86400) -> DataFrame:
    """2-d points ``[value, props.k]`` with an event-time tick; events without
    one of the two numbers are in ``event_rejects``."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("event_id").alias("id"),
        F.array(F.col("value").cast("double"), k).alias("x"),
        event_tick("ts", interval_seconds).alias("tick"),
        F.col("user_id"),
    ).where(F.col("x")[0].isNotNull() & F.col("x")[1].isNotNull())


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-d points ``[quantity, extendedprice, discount, tax]`` (no unique id:
    ``id`` is the row's position key, used only for arrival order)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"),
        event_tick("l_shipdate", 86400 * 30, "1992-01-01 00:00:00").alias("tick"),
    )
