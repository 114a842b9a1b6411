"""Vector tables for the two searches: which rows take part, equal vectors as
one point, blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch


def points(vectors: DataFrame, scratch: Scratch, keep: int, id_col: str, vec_col: str, each, ok=None) -> tuple[DataFrame, DataFrame]:
    """(points, holders) of the rows whose vector is whole (not null, no null,
    NaN or infinite component): ``points`` has one row per different vector
    (uid, v array<double>, d, ids: its ``keep`` smallest ids), ``holders``
    (uid, id) one per id. ``each`` maps a component (double) to the component
    compared, ``ok`` may refuse a vector by its mapped array."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    whole = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"))
        .where(F.col("id").isNotNull() & whole)
        .select("id", F.transform("x", each).alias("v"))
    )
    if ok is not None:
        rows = rows.where(ok(F.col("v")))
    rows = rows.distinct()
    low = rows.groupBy("v").agg(F.min("id").alias("low"))
    named = scratch.keep(low.select(F.monotonically_increasing_id().alias("uid"), "v", "low"), "vectors")
    holders = scratch.keep(rows.join(named, "v").select("uid", "id"), "holders")
    # the smallest ids of a vector: Spark prunes a hot vector before the shuffle
    first = holders.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where(F.col("r") <= keep)
    ids = first.groupBy("uid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    out = named.join(ids, "uid").select("uid", "v", F.size("v").alias("d"), "ids", "low")
    return scratch.keep(out, "points"), holders


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long double vectors as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def ranked(found: DataFrame, holders: DataFrame, points_: DataFrame, queries, k: int) -> DataFrame:
    """Best points per query point (q, p, score) -> (query_id, rank, vec_id,
    score) for every id of the query's vector that ``queries`` accepts."""
    best = found.join(points_.select(F.col("uid").alias("p"), "ids", "low"), "p")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("low"))
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))  # at most k + 1 vectors of k + 1 ids
    asked = holders.where(queries(F.col("id"))).select(F.col("uid").alias("q"), F.col("id").alias("query_id"))
    out = asked.join(best, "q").select("query_id", F.explode("hits").alias("h")).select("query_id", F.explode("h.ids").alias("vec_id"), F.col("h.score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        out.where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
