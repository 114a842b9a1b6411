"""Web archives in Zstandard: one frame per record, one dictionary per file.

Writing: pages are dealt by key into as many archives as keep one near
``ARCHIVE_BYTES``; equal payloads are found by their digest (one aggregate of
short rows), the one with the smallest page_id becomes a ``response`` record,
the others ``revisit`` records that refer to it. A task turns a page into a
WARC record and the record into one Zstandard frame; the archive starts with a
skippable frame that holds the dictionary (trained on at most ``SAMPLE``
payload heads, chosen by hash). Spark's text writer commits the files: its
"lines" are frames, and its line separator is an empty skippable frame, which
every Zstandard reader passes over. So a lost or repeated task leaves no half
archive, on any file system that Spark writes to.

Reading: files come through Spark's binary reader; a task loads the dictionary
from the leading skippable frame, decodes frame after frame, checks that each
frame holds exactly one record, that the headers are there, that lengths and
digests agree, and raises on the first that does not.

Defined cases: a null html is an empty payload; a null url gives a record
without target; rows that repeat a page_id with the same payload are written
alike (both responses or both revisits); a null page_id is always a response
and never referred to; other columns are ignored; an empty table gives
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

ARCHIVE_BYTES = 24 << 20
SAMPLE = 400
SAMPLE_BYTES = 8192
DICT_BYTES = 64 << 10
MIN_REVISIT_BYTES = 0

# Fixed values of the formats: Zstandard magic numbers, WARC names.
FRAME_MAGIC = 0xFD2FB528
DICT_FRAME_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _plain_value(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, headers and block."""
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Date", date),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _header_value(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + digest))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    block = b"" if revisit else payload
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8") for k, v in head), b"", block]) + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; raises ValueError if it is not whole."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(": ")
        if not colon:
            raise ValueError(f"malformed header {line!r}")
        headers[name] = value
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if name not in headers:
            raise ValueError(f"record without {name}")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record length {len(rest) - 4} is not its Content-Length {n}")
    return headers, rest[:n]


def read_archive(data: bytes):
    """Records of one archive, frame by frame."""
    at, view, dictionary = 0, memoryview(data), None
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # skippable
            if at + 8 + size > len(data):
                raise ValueError("archive ends inside a skippable frame")
            if magic == DICT_FRAME_MAGIC and at == 0:
                body = data[8 : 8 + size]
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        out = []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a frame")
            out.append(frame.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(data))
        at -= len(frame.unused_data)
        yield read_record(b"".join(out))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples; their start if they are too few
    to train on; nothing without samples."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _frame_fn(dictionary: bytes, date: str):
    def fn(batches):
        packer, first = None, True
        for batch in batches:
            if packer is None:
                d = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
                packer = zstandard.ZstdCompressor(level=3, dict_data=d) if d else zstandard.ZstdCompressor(level=3)
            names = batch.schema.names
            out = []
            if first and len(dictionary) >= 8:
                body = zstandard.ZstdCompressor(level=9).compress(dictionary)
                out.append(struct.pack("<II", DICT_FRAME_MAGIC, len(body)) + body)
            first = False
            cols = (batch.column(names.index(c)) for c in ("page_id", "url", "payload", "sha1", "refers_to"))
            for page_id, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in cols)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode("ascii")
                out.append(packer.compress(write_record(page_id, url, payload, digest, refers_to, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return fn


def write_archives(spark: SparkSession, pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` into archives under ``path``."""
    scratch = Scratch(spark, "warc")
    base = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # page and payload: where equal payloads lie does not depend on the payload
    key = F.concat_ws(" ", F.col("page_id").cast("string"), F.col("sha1"))
    base = base.withColumn("key", key)
    # the sample: keys first (short rows), then the heads of these SAMPLE pages
    chosen = base.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select(F.col("key").alias("sampled"))
    heads = base.join(F.broadcast(chosen), base["key"] == F.col("sampled"), "left_semi").select(F.substring("payload", 1, SAMPLE_BYTES).alias("head"))
    dictionary = train_dictionary(sorted({bytes(r["head"]) for r in heads.dropDuplicates().collect()}))  # bounded sample
    size = base.agg(F.sum(F.octet_length("payload") + 512)).first()[0] or 0
    # no fewer than Spark's own shuffles have, or the join would deal pages again
    archives = max(1, -(-int(size) // ARCHIVE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    short = base.where((F.octet_length("payload") >= min_revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1", "key")
    # written, so that Spark can split the join on a digest that many pages share
    lowest = scratch.keep(short.groupBy("sha1").agg(F.min("page_id").alias("lowest")), "lowest")
    later = short.join(lowest, "sha1").where("page_id > lowest").select("key", F.col("lowest").alias("refers_to")).distinct()
    dealt = base.repartition(archives, "key")
    frames = dealt.join(later, "key", "left").select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(_frame_fn(dictionary, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def _page(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if m is None:
        raise ValueError(f"unknown record id {uri}")
    return int(m[1]) if m[1] else None


def _read_fn(batches):
    for batch in batches:
        for data in batch.column(0):
            rows: list[tuple] = []
            size = 0
            for headers, block in read_archive(data.as_py()):
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(block).digest()).decode("ascii") != digest:
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not agree")
                elif kind != "revisit" or "WARC-Refers-To" not in headers or block:
                    raise ValueError(f"unexpected record {headers['WARC-Record-ID']}")
                url = headers.get("WARC-Target-URI")
                rows.append((
                    _page(headers["WARC-Record-ID"]), kind, len(block) if kind == "response" else None, digest,
                    _page(headers["WARC-Refers-To"]) if kind == "revisit" else None, None if url is None else _plain_value(url), block if kind == "response" else None,
                ))
                size += len(block)
                if size > 4 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; a revisit has neither
    length nor payload."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_read_fn, RECORDS)


def roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the records back; a revisit takes its payload's
    length from the record it refers to."""
    path = f"{Scratch(spark, 'warc').base}/archives"
    write_archives(spark, pages, path)
    records = read_archives(spark, path).drop("payload", "url")
    full = records.where("record_type = 'response'")
    size = full.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("n")).distinct()
    again = records.where("record_type = 'revisit'").drop("payload_bytes").join(size, ["refers_to", "payload_digest"], "left").withColumnRenamed("n", "payload_bytes")
    return full.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
