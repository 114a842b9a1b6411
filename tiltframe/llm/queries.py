"""Queries of the training-data operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .ann import nearest
from .bpe import bpe_encode
from .cover_tree import top_k
from .jaccard_join import near_duplicates
from .line_dedup import line_dedup
from .packing import pack
from .phrase_dedup import phrase_dedup
from .quality import resample
from .spelling import variants, word_counts
from .suffix_dedup import suffix_dedup
from .url_filter import filter_urls, host_of
from .warc import roundtrip
from .whitening import whiten

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = resample(spark, _table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels"))
    return out.select("row.doc_id", "log_weight", "key")


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup(spark, _table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def url_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Captures and dated entries from the given tables. A page was fetched
    7,919 s x page_id into January 2024 (round a 30-day month). Event e speaks
    of the page e mod (largest page_id + 1): "purchase" and "error" block its
    host from the event's time on, "signup" allows it, "click" blocks the host's
    first path segment, "view" allows that."""
    pages, events = _table(spark, sf, "pages"), _table(spark, sf, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    captures = pages.select("page_id", "url", (start + F.make_dt_interval(secs=(F.col("page_id") * 7919) % 2_592_000)).alias("fetched"))
    host = host_of(F.col("url"))
    first = F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]+)", 1)
    of = pages.select("page_id", host.alias("host"), first.alias("first"))
    n = pages.agg(F.max("page_id") + 1).first()[0] or 1
    kind = F.col("event_type")
    entries = events.select((F.col("event_id") % n).alias("page_id"), "event_type", "ts").join(of, "page_id")
    entries = entries.select(
        F.when(kind.isin("click", "view"), F.concat_ws("/", "host", "first")).otherwise(F.col("host")).alias("pattern"),
        kind.isin("purchase", "error", "click").alias("blocks"), F.col("ts").alias("since"),
    )
    return captures, entries


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    captures, entries = url_lists(spark, sf)
    out = filter_urls(captures, entries)
    return out.select("page_id", "host", "blocked", "blocked_by", F.unix_micros(F.col("blocked_since")).alias("blocked_since"), "n_active")


def op5_bpe_encoding(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe_encode(spark, _table(spark, sf, "documents"), WORD_BPE)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(spark, _table(spark, sf, "documents"), BYTE_BPE)


def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark, _table(spark, sf, "embeddings"), lambda i: i % 20 == 0, 20)


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return roundtrip(spark, _table(spark, sf, "pages"))


def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(spark, _table(spark, sf, "embeddings"), lambda i: i % 50 == 0, 5)


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf, "documents"))


def op11_phrase_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = phrase_dedup(spark, _table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, word_counts(_table(spark, sf, "documents"), drop_every=97))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(spark, _table(spark, sf, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_line_dedup, op3_suffix_dedup, op4_url_filter, op5_bpe_encoding,
        op6_packing, op7_nearest_neighbours, op8_warc, op9_exact_topk, op10_jaccard_join,
        op11_phrase_dedup, op12_spelling_variants, op13_whitening,
    )
}

_LINE_KEY = (
    "translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

OP2_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
split AS (SELECT rid, doc_id, id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT rid, doc_id, id, pos, l, {_LINE_KEY} AS k FROM split),
hot AS (
  SELECT k, max(id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT id) >= 5),
marked AS (
  SELECT rid, doc_id, pos, l, hot.k IS NOT NULL AND id <> keeper AS gone
  FROM keyed LEFT JOIN hot USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

OP4_SQL = r"""
WITH hosts AS (
  SELECT page_id, url,
         translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]+)', 1) AS first,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 2592000) AS t
  FROM pages),
entries AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN host || '/' || first ELSE host END AS pattern,
         ts AS since, max(CASE WHEN event_type IN ('purchase', 'error', 'click') THEN 1 ELSE 0 END) AS blocks
  FROM events JOIN hosts ON event_id % (SELECT max(page_id) + 1 FROM pages) = page_id
  GROUP BY 1, 2),
held AS (
  SELECT pattern, since, blocks, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM entries),
named AS (
  SELECT page_id, host, t, url,
         host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') || '/' AS full_path
  FROM hosts),
active AS (
  SELECT page_id, url, t, pattern, since FROM named JOIN held
  ON blocks = 1 AND t >= since AND (until IS NULL OR t < until)
     AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(full_path, pattern || '/')))),
best AS (
  SELECT page_id, count(*) AS n_active, max({'n': length(pattern), 'p': pattern, 's': since}) AS b FROM active GROUP BY page_id)
SELECT n.page_id, nullif(host, '') AS host, b.page_id IS NOT NULL AS blocked, b.b.p AS blocked_by,
       epoch_us(b.b.s) AS blocked_since, coalesce(b.n_active, 0) AS n_active
FROM named n LEFT JOIN best b USING (page_id)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, octet_length(payload) AS n, h, min(page_id) OVER (PARTITION BY h) AS lowest FROM p),
coded AS (
  SELECT page_id, n, lowest,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(((CAST('0x' || substr(h || '00000000', 1 + (i * 5) // 4, 3) AS BIGINT) << ((i * 5) % 4)) >> 7) & 31 AS INTEGER), 1)), '') AS digest
  FROM bits)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lowest THEN NULL ELSE lowest END AS refers_to
FROM coded
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

OP9_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE {_WHOLE}),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT rid, id, s, array_to_string(w[s + 1 : s + 20], ' ') AS phrase
  FROM (SELECT rid, id, w, unnest(range(0, len(w) - 19)) AS s FROM docs WHERE len(w) >= 20)),
first AS (SELECT phrase, min({'id': id, 's': s}) AS f FROM windows GROUP BY phrase HAVING count(*) > 1),
late AS (SELECT DISTINCT rid, s FROM windows JOIN first USING (phrase) WHERE id <> f.id OR s <> f.s),
each AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
marked AS (
  SELECT e.rid, e.word, e.i,
         coalesce(max(l.s) OVER (PARTITION BY e.rid ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > e.i - 20, false) AS gone
  FROM each e LEFT JOIN late l ON l.rid = e.rid AND l.s = e.i),
kept AS (
  SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t
  FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

# crc32 by half bytes. Its table for the 16 half bytes.
_CRC16 = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)
_HALF = f"xor(c >> 4, ({_CRC16})[1 + (xor(c, %s) & 15)])"

OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
held AS (SELECT id, run, count(*) AS n, hex(id || ':' || run) AS x FROM runs WHERE length(run) >= 5 GROUP BY id, run),
nibbles AS (
  SELECT id, run, n, list_transform(range(0, len(x)), lambda i: CAST('0x' || substr(x, CAST(i + 2 - 2 * (i % 2) AS INTEGER), 1) AS BIGINT)) AS b FROM held),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: {_HALF % 'v'}), 4294967295) AS h FROM nibbles),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM hashed),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS k FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
spots AS (SELECT word, n, k, unnest(range(1, k + 1)) AS i FROM vocabulary),
cuts AS (SELECT word, n, k, i, substr(word, 1, CAST(i - 1 AS INTEGER)) AS a, substr(word, CAST(i + 1 AS INTEGER)) AS z FROM spots),
pairs AS (
  SELECT DISTINCT c.word, v.word AS near, v.n AS near_n, c.n FROM cuts c JOIN vocabulary v ON v.word = c.a || c.z
  UNION
  SELECT DISTINCT c.word, d.word, d.n, c.n FROM cuts c JOIN cuts d ON c.a = d.a AND c.z = d.z WHERE c.word <> d.word),
both_ways AS (SELECT word, near, near_n FROM pairs UNION SELECT near, word, n FROM pairs),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM both_ways GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * v.n THEN b.top END AS form_n,
         CASE WHEN b.top >= 2 * v.n THEN (SELECT min(near) FROM both_ways w WHERE w.word = v.word AND w.near_n = b.top) END AS form
  FROM vocabulary v LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c USING (word) JOIN formed r ON r.word = c.root AND r.form IS NULL
"""

SQL = {"op11_phrase_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op2_line_dedup": OP2_SQL, "op4_url_filter": OP4_SQL, "op8_warc": OP8_SQL, "op9_exact_topk": OP9_SQL}
