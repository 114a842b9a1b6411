"""Row numbers over a data-sized table without a one-task window.

A global sort range-partitions the rows; each row's place in its partition
comes from the sort, and the partitions' sizes (one number each) give the
offsets. Only the sorted table in the shared folder is read twice, so both
passes see the same partitions, also after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_run_dir

_BITS = 33  # monotonically_increasing_id: partition number above, place below


def numbered(df: DataFrame, order: list, name: str, folder: str | None = None) -> DataFrame:
    """``df`` with ``name`` (long): 1, 2, ... in the order of ``order``."""
    spark = df.sparkSession
    path = folder or new_run_dir(spark, "numbered")
    rows = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    part = F.shiftright("_row", _BITS)
    sizes = rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # one row a partition
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r["_part"], before))
        before += r["count"]
    at = spark.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_row").bitwiseAND(F.lit((1 << _BITS) - 1)) + F.col("_before") + 1
    out = rows.withColumn("_part", part).join(F.broadcast(at), "_part")  # one row a partition
    return out.select(*df.columns, place.alias(name))
