"""Connected components of a link table, on Spark (alternating large-star and
small-star steps): every step is a keyed minimum plus a join, each round is a
table in the shared folder, and no component is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): every directed edge with the least of u and u's neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(low, "u")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) -> (node, component): the least node of each
    component, for every node that has a link."""
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        s = _star(large)
        small = s.select("v", "m").unionByName(s.select(F.col("u").alias("v"), "m")).where("v <> m")
        edges = scratch.keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
