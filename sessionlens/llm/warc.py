"""WARC archives: records of web pages written in segments, and put together again.

Writing: a response holds an HTTP message with a chunked body; of equal payloads the first is a response and the
others are revisits that refer to it. Messages above a size go into several records: the first segment, then
continuations that name its id, number themselves and end with the total length. Records are the lines of Spark's
text writer, with the two line ends that close a record between them, so archives go wherever Spark can write.

Reading: archives are split into records by their lengths. Whole messages are decoded where they are read.
Segments are grouped by origin, ordered by number and checked against the total length before they are decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlens.llm.common import slices
from sessionlens.sources.sinks import staged

REVISIT_FROM = 100  # bytes of a payload from which equal ones are revisits
SEGMENT_BYTES = 32768
CHUNK_BYTES = 8192
FILE_RECORDS = 4096  # records in an archive: at most 128 MB, as an archive is read by one task
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

_RECORD = "page_id long, url string, record_type string, record_id string, refers_to string, payload_digest string, payload binary"
_PART = _RECORD + ", origin string, segment int, total long"


def _message(payload: bytes | None) -> bytes:
    """An HTTP response; its body in chunks, or none for a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if payload is None:
        return head
    chunks = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return head + b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in chunks) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The bytes inside chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def decoded(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP message without an end of its headers")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _records(segment_bytes: int):
    def header(fields: list[tuple[str, object]], block: bytes) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for row in batch.to_pylist():
                revisit = row["refers_to"] is not None
                block = _message(None if revisit else row["payload"])
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                url = row["url"] and "".join(f"%{ord(c):02X}" if c < " " else c for c in row["url"])
                name, several = f"<urn:uuid:{row['record_id']}>", len(parts) > 1
                common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", row["page_id"])]
                kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{row['refers_to']}>")] if revisit else [("WARC-Type", "response")]
                digest = ("WARC-Payload-Digest", "sha256:" + row["digest"])
                out.append(header([*kind, ("WARC-Record-ID", name), *common, digest, ("WARC-Segment-Number", 1 if several else None), ("Content-Type", "application/http;msgtype=response")], parts[0]))
                for number, part in enumerate(parts[1:], 2):
                    total = len(block) if number == len(parts) else None
                    own = hashlib.md5(f"{row['record_id']} {number}".encode()).hexdigest()
                    own = f"<urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}>"
                    out.append(header([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total), *common], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row (page_id, url, html) to archives in ``path``.

    Null html is an empty payload. Of equal payloads of 100 bytes or more the row with the smallest page_id (null
    last, then url) is the response and the others are revisits, repeated rows included; smaller ones are all
    responses. Other columns are not looked at. An empty table gives archives without records.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    place = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    keys = rows.select(place.alias("place"), "digest", (F.length("payload") >= REVISIT_FROM).alias("long"))
    counted = keys.groupBy("place", "digest", "long").agg(F.count("*").alias("times"))
    # Payloads that occur once need nothing more; the others meet the first of their kind.
    again = counted.groupBy("digest").agg(F.min("place").alias("first"), F.sum("times").alias("n"), F.max("times").alias("most")).where("n > 1")
    again = staged(again)
    rows = rows.join(again.select("digest", "first", "most"), "digest", "left").withColumn("place", place)
    rows = rows.withColumn("turn", F.lit(1))
    if not again.where("most > 1").isEmpty():  # rows that are repeated in all columns are told apart
        one = rows.where(F.coalesce("most", F.lit(1)) == 1)
        turn = F.row_number().over(Window.partitionBy("digest", "place").orderBy(F.lit(1)))
        rows = one.union(rows.where("most > 1").withColumn("turn", turn))
    full = F.length("payload") >= REVISIT_FROM
    head = F.col("first").isNull() | (F.col("place").eqNullSafe(F.col("first")) & (F.col("turn") == 1))

    def uuid(*parts: Column) -> Column:
        x = F.md5(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
        return F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")

    response = uuid(F.lit("response"), F.col("digest"))
    own = uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("turn"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(full & head, response).otherwise(own).alias("record_id"), F.when(full & ~head, response).alias("refers_to"))
    records = rows.mapInArrow(_records(segment_bytes), "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start:stop]
        at = stop + 4


def _plain(name: str | None) -> str | None:
    return name and name.removeprefix("<urn:uuid:").removesuffix(">")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PART.split(", ")]
    types = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string(), pa.int32(), pa.int64()]
    for batch in slices(batches, 1):
        out, size = [], 0
        for fields, block in split_records(batch.column("content")[0].as_py()):
            kind, number = fields["warc-type"], fields.get("warc-segment-number")
            record_id, page = _plain(fields["warc-record-id"]), fields.get("page-id")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            origin = _plain(fields.get("warc-segment-origin-id")) or record_id if number else None
            total = fields.get("warc-segment-total-length")
            payload = block if number else decoded(block) if kind == "response" else None
            out.append((int(page) if page else None, fields.get("warc-target-uri"), kind, record_id, _plain(fields.get("warc-refers-to")), digest, payload, origin, int(number) if number else None, int(total) if total else None))
            size += len(block)
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _assemble(parts: pd.DataFrame) -> pd.DataFrame:
    """One message from its segments."""
    parts = parts.drop_duplicates("segment").sort_values("segment")
    message, last = b"".join(parts["payload"]), parts.iloc[-1]
    if parts["segment"].tolist() != list(range(1, len(parts) + 1)) or pd.isna(last["total"]) or int(last["total"]) != len(message):
        raise ValueError(f"segments of record {last['origin']} are missing")
    first = parts.iloc[[0]].copy()
    first["payload"] = [decoded(message) if first["record_type"].iloc[0] == "response" else None]
    return first[["page_id", "url", "record_type", "record_id", "refers_to", "payload_digest", "payload"]]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, record_id, refers_to (a record id), payload_digest (as declared), payload.

    One row for each response and revisit in the archives of ``path``; the payload of a revisit is null. Records
    of other types are passed over. A damaged archive, a missing segment or a wrong total length is an error.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    parts = files.mapInArrow(_parse, _PART)
    whole = parts.where("segment is null and record_type in ('response', 'revisit')").drop("origin", "segment", "total")
    split = parts.where("segment is not null")
    return whole.union(split.groupBy("origin").applyInPandas(_assemble, _RECORD))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id): revisits with what they refer to; an error where that is missing."""
    slim = records.select("page_id", "record_type", "record_id", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"), "payload_digest")
    slim = slim.withColumn("digest", F.when((F.col("record_type") == "revisit") | (F.col("digest") == F.col("payload_digest")), F.col("digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    slim = staged(slim)
    first = slim.where("record_type = 'response'")
    named = first.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), "payload_bytes", F.col("digest").alias("payload_digest"))
    revisits = slim.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(named, "refers_to", "left")
    there = F.when(F.col("first_id").isNotNull() | F.col("payload_digest").isNotNull(), F.col("record_type"))
    revisits = revisits.withColumn("record_type", there.otherwise(F.raise_error(F.lit("a revisit refers to a record that is not in the archives"))))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    plain = first.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.union(revisits.select(*columns, F.col("first_id").alias("refers_to")))
