"""Streaming sources of points (Structured Streaming).

Any streaming DataFrame with a vector column can feed the online phase;
these helpers cover the two sources of the original programs: a folder
where new text files appear, and a TCP socket of text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import parse_vectors


def text_file_stream(spark: SparkSession, path: str, dim: int | None = None, drop_label: bool = False, max_files_per_trigger: int = 1):
    """New text files in ``path`` become micro-batches; returns (points,
    rejects) streams (see ``parse_vectors``)."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return parse_vectors(lines, "value", dim, drop_label)


def parquet_file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files in ``path`` become micro-batches (schema given:
    streaming file sources do not infer)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def socket_stream(spark: SparkSession, host: str, port: int, dim: int | None = None, drop_label: bool = False):
    """Text lines from a TCP socket (Spark's built-in ``socket`` source;
    not fault tolerant, for demos). Returns (points, rejects) streams."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return parse_vectors(lines, "value", dim, drop_label)
