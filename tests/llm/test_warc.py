from __future__ import annotations

import hashlib

import pytest

from sessionlens.llm import warc as W
from sessionlens.sources.sinks import stage_path


def round_trip(spark, rows, segment=64):
    path = stage_path(spark)
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment)
    return path, W.read_warc(spark, path)


def test_payloads_come_back_whole(spark):
    big = "".join(f"<p>é line {i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(4000))  # many chunks and segments
    rows = [(i, f"http://x/{i}", "é" * i + "\r\n\r\n") for i in range(40)] + [(100, "http://big", big), (101, None, None), (102, "http://e\r\nvil: 1", "")]
    path, records = round_trip(spark, rows)
    got = {r["page_id"]: bytes(r["payload"]) for r in records.collect()}
    assert got == {i: (h or "").encode() for i, _, h in rows}
    text = b"".join(open(f.removeprefix("file:"), "rb").read() for f in spark.read.format("binaryFile").load(path).toPandas()["path"])
    assert text.count(b"WARC-Type: continuation") > 100 and text.count(b"WARC-Segment-Total-Length") > 1


def test_equal_payloads_are_revisits(spark):
    page, small = "x" * 100, "y" * 99
    rows = [(5, "u5", page), (3, "u3", page), (9, "u9", page), (3, "u3", page), (1, "a", small), (2, "b", small), (None, "n", page), (7, "z", None), (8, "z", None)]
    _, records = round_trip(spark, rows)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.resolved(records).collect()), key=str)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(3, 100, digest(page), "response", None), *[(i, 100, digest(page), "revisit", 3) for i in (0, 3, 5, 9)]]
    want += [(i, 99, digest(small), "response", None) for i in (1, 2)] + [(i, 0, digest(""), "response", None) for i in (7, 8)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    _, records = round_trip(spark, [])
    assert records.count() == 0 and W.resolved(records).count() == 0


def test_damage_is_an_error(spark):
    path, _ = round_trip(spark, [(1, "u", "word " * 200)])
    (name,) = (p.removeprefix("file:") for p in spark.read.format("binaryFile").load(path).toPandas()["path"])
    data = open(name, "rb").read()
    parts = data.split(b"\r\n\r\nWARC/1.1\r\n")
    for broken in (data[:-20], b"x" + data, b"\r\n\r\nWARC/1.1\r\n".join(parts[:3] + parts[4:])):
        other = stage_path(spark)
        spark.createDataFrame([(broken.decode(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(other)
        with pytest.raises(Exception, match="cut short|no record|are missing|WARC"):
            W.read_warc(spark, other).collect()


def test_chunked_framing():
    assert W.unchunked(b"4;name=v\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia"
    assert W.decoded(b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n1\r\na\r\n0\r\n\r\n") == b"a"
    assert W.decoded(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"1\r\naXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.unchunked(bad)
    assert all(W.decoded(W._message(p)) == p for p in (b"", b"x" * W.CHUNK_BYTES, b"\r\n0\r\n\r\n" * 5000))
