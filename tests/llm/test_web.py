"""Web archives and URL lists."""

import base64
import datetime as dt
import hashlib
import struct

import pytest
import zstandard

import tiltframe.llm.warc as warc
from tiltframe.llm.url_filter import filter_urls

PAGES = "page_id long, url string, html string, key int, sha1 string"


def _pages():
    rows = [(i, f"http://h{i}.example/a b%20\r\nc", f"<html>page {i % 7}</html>" * (1 + i % 3), 1, "x") for i in range(60)]
    return rows + [(100, None, None, 1, "x"), (101, "u", "", 1, "x"), (102, "u", "é" * 200_000, 1, "x"), (5, "u", "<html>page 5</html>" * 3, 1, "x"), (5, "v", "other", 1, "x"), (None, "n", "<html>page 1</html>", 1, "x")]


def _want(rows):
    low = {}
    for p, _, h, *_ in rows:
        if p is not None:
            low[h or ""] = min(p, low.get(h or "", p))
    out = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        to = low[h or ""] if p is not None and p != low[h or ""] else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [24 << 20, 20_000])
def test_roundtrip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rows = _pages()
    got = sorted((tuple(r) for r in warc.roundtrip(spark, spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert got == _want(rows)


def test_contents_survive(spark, tmp_path):
    rows = _pages()
    path = str(tmp_path / "archives")
    warc.write_archives(spark, spark.createDataFrame(rows, PAGES), path)
    full = {(r.page_id, r.url, bytes(r.payload).decode()) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert full <= {(p, u, h or "") for p, u, h, *_ in rows}
    heads = [f.read_bytes()[:4] for f in (tmp_path / "archives").glob("part-*") if f.stat().st_size]
    assert heads and all(h == struct.pack("<I", warc.DICT_FRAME_MAGIC) for h in heads)


def test_no_pages(spark):
    assert warc.roundtrip(spark, spark.createDataFrame([], PAGES)).count() == 0


def _archive(*records):
    return b"".join(zstandard.ZstdCompressor().compress(r) + warc.EMPTY_FRAME for r in records)


def test_reader_refuses_broken_records():
    good = warc.write_record(1, "u", b"abc", "D", None, "1970-01-01T00:00:00Z")
    assert [b for _, b in warc.read_archive(_archive(good, good))] == [b"abc", b"abc"]
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            list(warc.read_archive(_archive(bad)))
    for cut in (_archive(good)[:-3], _archive(good)[:20], b"garbage bytes"):
        with pytest.raises(ValueError):
            list(warc.read_archive(cut))


def _t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_urls_by_time(spark):
    entries = [
        ("example.com", True, _t(3)), ("example.com", False, _t(10)), ("example.com", True, _t(20)),
        ("Shop.example.com/Deals", True, _t(5)), ("tie.org", True, _t(2)), ("tie.org", False, _t(2)), (None, True, _t(1)), ("x.org", None, _t(1)), ("y.org", True, None),
    ]
    captures = [
        (1, "http://example.com/", _t(2)), (2, "http://a.EXAMPLE.com/x", _t(4)), (3, "http://notexample.com/", _t(4)),
        (4, "http://example.com:80/?q", _t(10)), (5, "http://example.com", _t(31)), (6, "https://shop.example.com/Deals/1", _t(12)),
        (7, "https://shop.example.com/deals/1", _t(12)), (8, "https://shop.example.com/Dealsmore", _t(12)), (9, "http://user@tie.org/", _t(2)),
        (10, None, _t(4)), (11, "nothing", _t(4)), (12, "http://example.com/", None), (13, "http://x.org/", _t(4)), (14, "http://y.org/", _t(4)), (2, "http://a.EXAMPLE.com/x", _t(4)),
    ]
    e = spark.createDataFrame(entries, "pattern string, blocks boolean, since timestamp")
    c = spark.createDataFrame([(*x, "k", 0) for x in captures], "id int, url string, fetched timestamp, pattern string, blocked int")
    out = filter_urls(c, e)
    assert out.columns == ["id", "url", "fetched", "pattern", "host", "blocked", "blocked_by", "blocked_since", "n_active"]
    rows = [(r.id, r.blocked, r.blocked_by, r.n_active) for r in out.collect()]
    want = {
        1: (False, None, 0), 2: (True, "example.com", 1), 3: (False, None, 0), 4: (False, None, 0), 5: (True, "example.com", 1),
        6: (True, "shop.example.com/Deals", 1), 7: (False, None, 0), 8: (False, None, 0), 9: (True, "tie.org", 1),
        10: (False, None, 0), 11: (False, None, 0), 12: (False, None, 0), 13: (False, None, 0), 14: (False, None, 0),
    }
    assert len(rows) == len(captures) and all(r[1:] == want[r[0]] for r in rows)
    assert filter_urls(c.limit(0), e).count() == 0
    assert filter_urls(c, e.limit(0)).where("blocked").count() == 0
