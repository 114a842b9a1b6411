"""Corpus pipeline over ``documents``: quality resampling, line dedup, near
duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's
``docs``. All stages but the last return the columns of ``documents``;
``n_chars`` follows the text. Two stages differ from the operators' query
defaults: near duplicates take five words and a similarity of 0.8.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltframe.llm.jaccard_join import near_duplicates
from tiltframe.llm.line_dedup import line_dedup
from tiltframe.llm.packing import pack
from tiltframe.llm.quality import resample
from tiltframe.llm.storage import Scratch
from tiltframe.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled good."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return resample(spark, docs, labels).select(*(F.col("row")[c].alias(c) for c in COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    return _documents(line_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    groups = near_duplicates(spark, docs, k=5, num=4, den=5)
    later = groups.where("component_id <> doc_id").select("doc_id").distinct()
    # equal rows of one doc_id are one document
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated substrings go; a character of which a byte goes, goes whole."""
    out = suffix_dedup(spark, docs)
    return _documents(out.select(*(F.col("row")[c].alias(c) for c in COLUMNS if c != "text"), F.col("kept_text").alias("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens."""
    return pack(spark, docs, BYTE_BPE)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_copies),
    ("suffix_dedup", substrings),
    ("packing", packing),
]

#: The stages on suffix orders, similarity links and token ids are not SQL;
#: the tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
