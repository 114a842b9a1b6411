"""URL lists over time: which list entries hold for a capture when it was made.

Dated entries (pattern, blocks or allows, from when) become validity intervals:
an entry holds until the next one of its pattern. A pattern is a host, which
covers its subdomains, or a host with leading path segments. A capture is
looked up under every pattern that could cover it, as of its fetch time.

Scale: both sides of the as-of join are keyed by (pattern, time bucket); an
interval is repeated for each bucket it covers, which for the intervals of one
pattern adds at most one row per bucket. So a pattern that holds a third of all
captures or entries is split by time (and further by Spark's skew join), the
next entry across buckets comes from one row per bucket, and no window runs
over all entries of a pattern.

Defined cases: a null, relative or otherwise host-less url, or a null fetch
time, is never blocked; entries with a null pattern, action or date do not
count; of entries of one pattern at one time, blocking wins; hosts and
patterns are compared in lower case (A-Z), paths as they are; repeated
captures are each answered; extra columns stay, result columns replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 86_400
RESULTS = ("host", "blocked", "blocked_by", "blocked_since", "n_active")

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url):
    return F.translate(F.regexp_extract(url, HOST, 1), _UPPER, _UPPER.lower())


def patterns_of(host, path):
    """All patterns that could cover a url: each domain suffix of the host with
    at least two labels (or the only label), and host with path segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, paths))


def _bucket(seconds):
    return F.floor(seconds / F.lit(BUCKET_SECONDS)).cast("long")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) of blocking entries, in microseconds since the
    epoch; ``until`` is null for an entry that still holds."""
    e = (
        entries.select("pattern", F.col("blocks").cast("boolean").alias("blocks"), F.unix_micros(F.col("since").cast("timestamp")).alias("since"))
        .where("pattern IS NOT NULL AND blocks IS NOT NULL AND since IS NOT NULL")
        .groupBy("pattern", "since").agg(F.max("blocks").alias("blocks"))
        .withColumn("bucket", _bucket(F.col("since") / F.lit(1_000_000)))
    )
    inside = Window.partitionBy("pattern", "bucket").orderBy("since")
    e = e.withColumn("next", F.lead("since").over(inside))
    firsts = e.groupBy("pattern", "bucket").agg(F.min("since").alias("first"))  # one row per pattern and bucket
    follow = firsts.withColumn("next_first", F.lead("first").over(Window.partitionBy("pattern").orderBy("bucket"))).drop("first")
    return e.join(follow, ["pattern", "bucket"]).where("blocks").select("pattern", "since", F.coalesce("next", "next_first").alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, blocked_by (the longest active pattern),
    blocked_since (its entry's date) and n_active (active blocking patterns).
    ``entries``: pattern string, blocks boolean, since timestamp."""
    url = F.col(f"`{url_col}`")
    when = F.unix_micros(F.col(f"`{time_col}`").cast("timestamp"))
    base = captures.select(
        F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), url.alias("u"), when.alias("t"),
        F.nullif(host_of(url), F.lit("")).alias("h"),
    ).withColumns({"k1": F.xxhash64("u", "t"), "k2": F.xxhash64(F.lit("capture"), "u", "t")})
    asked = base.where("h IS NOT NULL AND t IS NOT NULL").select(
        "k1", "k2", "t", F.explode(patterns_of(F.col("h"), F.regexp_extract("u", PATH, 1))).alias("pattern")
    ).distinct().withColumn("bucket", _bucket(F.col("t") / F.lit(1_000_000)))
    held = intervals(entries.withColumn("pattern", _fold(F.col("pattern"))))
    last = captures.select(_bucket(F.max(when) / F.lit(1_000_000)).alias("last"))  # one row
    covered = (
        held.crossJoin(F.broadcast(last))
        .withColumn("from", _bucket(F.col("since") / F.lit(1_000_000)))
        .withColumn("to", F.least(F.coalesce(_bucket((F.col("until") - 1) / F.lit(1_000_000)), F.col("last")), F.col("last")))
        .where(F.col("from") <= F.col("to"))
        .select("pattern", "since", "until", F.explode(F.sequence("from", "to")).alias("bucket"))
    )
    active = asked.join(covered, ["pattern", "bucket"]).where((F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    best = active.groupBy("k1", "k2").agg(
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"), F.count(F.lit(1)).alias("active")
    )
    out = base.join(best, ["k1", "k2"], "left")
    keep = [F.col("row")[c].alias(c) for c in captures.columns if c not in RESULTS]
    return out.select(
        *keep, F.col("h").alias("host"), F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("blocked_by"),
        F.timestamp_micros("best.since").alias("blocked_since"), F.coalesce("active", F.lit(0)).cast("long").alias("n_active"),
    )


def _fold(pattern):
    """The host part in lower case, the path as it is."""
    host = F.translate(F.substring_index(pattern, "/", 1), _UPPER, _UPPER.lower())
    return F.concat(host, F.substring(pattern, F.length(F.substring_index(pattern, "/", 1)) + 1, F.length(pattern)))
