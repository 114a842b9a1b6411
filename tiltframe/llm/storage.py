"""Tables in the shared folder: they cut lineage, so that a lost executor
costs the tasks of one step and not the whole job."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..session import new_run_dir, ship_package


#: Rows of one Arrow batch: texts of a few KB each make batches of some MB.
ARROW_ROWS = 1000
_DEFAULT_ROWS = "10000"


class Scratch:
    """One folder under ``spark.checkpoint.dir`` per run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)  # the tasks import this package
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(rows) == _DEFAULT_ROWS:  # a value of the user's own stays
            spark.conf.set(rows, str(ARROW_ROWS))
        self.spark, self.base, self._n = spark, new_run_dir(spark, name), 0

    def keep(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and read it back. ``free``: let Spark drop the
        shuffle files of what came before, which no later step reads; it does so
        once the driver has collected the plans, so that is asked for here."""
        self._n += 1
        path = f"{self.base}/{self._n:02d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if free:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out
