"""Line dedup: drop lines that many documents hold (DataFrame functions only).

Normalised lines are exploded and hashed, documents are counted per hash, the
lines over the threshold are dropped everywhere but in the largest doc_id
holding them, and the text is put together again by position.

Shuffles: one aggregate of line hashes (map-side combined, so a line that a
third of all documents hold sends one row per task), one join of line
positions with the few hashes that enough rows hold (Spark splits a skewed
hash), an exact count of the documents of those, and one join of the documents
with their dropped positions. Lines travel as 128-bit hashes; texts move once.

Defined cases: a null or empty text is one empty line; a null doc_id is one
document and ranks below every other; rows that repeat a doc_id are one
document, so they count once, and all rows with the largest doc_id keep the
line; no line, however long, is cut; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import SPACE_CHARS

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_ID = -(1 << 63)


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _UPPER.lower())


def _hashes(key):
    """Two independent 64-bit hashes of a key."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with the kept lines as ``text_col`` plus ``n_lines`` and
    ``n_dropped`` (columns of these names in the input are replaced)."""
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
    ).withColumn("text_hash", F.xxhash64("body"))

    def lines(c):
        return F.split(c, "\n", -1)

    # one entry per line, in order: the key, or null if it is too short to count
    keys = F.transform(lines(F.col("body")), lambda x: F.when(F.char_length(line_key(x)) >= min_chars, line_key(x)))
    per_doc = base.select("id", F.explode(F.array_distinct(keys)).alias("k")).where("k IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "lines")
    # rows first: no fewer than documents. Written: a side that comes straight
    # from a table lets Spark split the join on a hot line
    many = per_doc.select(*_hashes(F.col("k"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_docs)
    many = scratch.keep(many.select("h1", "h2"), "many")
    placed = base.select("id", "text_hash", F.posexplode(keys).alias("pos", "k")).where("k IS NOT NULL")
    placed = scratch.keep(placed.select("id", "text_hash", "pos", *_hashes(F.col("k"))).join(many, ["h1", "h2"]), "placed")
    frequent = (
        placed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    frequent = scratch.keep(frequent.select("h1", "h2", "keeper"), "frequent")
    dropped = placed.join(frequent, ["h1", "h2"]).where(F.col("id") != F.col("keeper")).groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    joined = base.join(dropped, ["id", "text_hash"], "left")
    all_lines = lines(F.col("body"))
    kept_pos = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(kept_pos, lambda i: F.get(all_lines, i)), "\n")
    )
    out = joined.select(
        "row",
        kept.alias("kept"),
        F.size(all_lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
    cols = [
        F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c)
        for c in docs.columns
        if c not in ("n_lines", "n_dropped")
    ]
    return out.select(*cols, "n_lines", "n_dropped")
