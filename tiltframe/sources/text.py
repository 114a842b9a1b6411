"""Text lines of space-separated numbers -> point vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(col: str):
    return F.split(F.trim(F.col(col)), " +")


def parse_vectors(df: DataFrame, col: str = "value", dim: int | None = None, drop_label: bool = False):
    """Split each line on spaces and cast every token to double.

    Returns ``(points, rejects)``: ``points`` keeps the other columns plus
    ``x ARRAY<DOUBLE>`` (and ``label STRING`` when ``drop_label``, the last
    token being the label); ``rejects`` holds lines with a token that is
    not a number, or whose length differs from ``dim``, and null lines, with
    a ``reason``.
    """
    toks = _tokens(col)
    keep = [c for c in df.columns if c != col]
    if drop_label:
        body = F.slice(toks, 1, F.size(toks) - 1)
        label = F.element_at(toks, -1)
    else:
        body = toks
        label = None
    parsed = df.select(
        *keep,
        F.col(col),
        F.transform(body, lambda t: t.try_cast("double")).alias("x"),
        *([label.alias("label")] if label is not None else []),
    )
    bad_token = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    bad_size = (F.size("x") != F.lit(dim)) if dim is not None else F.lit(False)
    reason = F.when(F.col(col).isNull(), F.lit("null_line")).when(bad_token, F.lit("bad_token")).when(bad_size, F.lit("bad_size"))
    tagged = parsed.withColumn("_reason", reason)
    points = tagged.where(F.col("_reason").isNull()).drop("_reason", col)
    rejects = tagged.where(F.col("_reason").isNotNull()).select(*keep, F.col(col), F.col("_reason").alias("reason"))
    return points, rejects


def read_text_points(spark: SparkSession, path: str, dim: int | None = None, drop_label: bool = False):
    """Batch scan of a text file / folder of point lines."""
    return parse_vectors(spark.read.text(path), "value", dim, drop_label)


def render_vectors(df: DataFrame, x: str = "x", out: str = "value") -> DataFrame:
    """Inverse of ``parse_vectors``: one space-separated line per point."""
    keep = [c for c in df.columns if c != x]
    return df.select(*keep, F.array_join(F.transform(x, lambda v: v.cast("string")), " ").alias(out))
