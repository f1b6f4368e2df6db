"""WARC archives: writing with segmented records, reading with reassembly.

Payloads go out in chunked transfer framing; a record whose block is longer
than a segment continues in `continuation` records.  Reading groups these by
the identifier of their origin, orders them by segment number, verifies the
total length and decodes the framing.

Archives are written by Spark's text sink (records end with two CRLFs, the
line separator used) and read as binary files; a file holds at most
FILE_RECORDS segments, so both sides have bounded memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import bounds, grouped
from .storage import Scratch, small_batches

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
FILE_RECORDS = 512
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same page has the same identifier whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in chunked transfer framing."""
    out = io.BytesIO()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.write(b"%x\r\n" % len(part) + part + CRLF)
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def unchunked(framed: bytes) -> bytes:
    """Undo `chunked`; raises ValueError on broken framing.  Chunk extensions and trailers are skipped."""
    out, at = io.BytesIO(), 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return out.getvalue()
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.write(framed[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {str(v).translate(_NO_BREAKS)}" for k, v in fields if v is not None], "", ""]
    return "\r\n".join(lines).encode()


_NO_BREAKS = {**{c: f"%{c:02X}" for c in range(32)}, 127: "%7F"}


def records_of(page_id: int | None, url: str | None, payload: bytes, original: dict | None, copies: int, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, without the two CRLFs at their end.  original: page and url of the response, for a revisit."""
    digest = digest_of(payload)
    own = record_id(page_id, url, digest)
    fields = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Copies", copies if copies > 1 else None)]
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked", b"", b""]
    if original is not None:
        block = CRLF.join(http)
        refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(original["page_id"], original["url"], digest)), ("X-Refers-To-Page-ID", original["page_id"])]
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, *refers, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = CRLF.join(http) + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        if number == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, ("Content-Type", "application/http;msgtype=response")]
            head += [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, url, f"{digest}#{number}")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
            head += [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield _header([*head, ("Content-Length", len(part))]) + part


def write_archives(spark: SparkSession, pages: DataFrame, path: str, scratch: Scratch, least_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write `pages` (page_id, url, html) as gzip archives under `path`.

    Of equal payloads of at least `least_revisit` bytes the record with the
    largest page_id is the response and others revisit it.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    skinny = pages.select("page_id", "url", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("n"))
    # one record for rows that repeat page, address and payload
    skinny = scratch.store(skinny.groupBy("page_id", "url", "key", "n").agg(F.count("*").alias("copies")), "pages")
    first = skinny.where(F.col("n") >= least_revisit).groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("members")).where("members > 1")
    plan = skinny.join(first.drop("members"), "key", "left")
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    plan = scratch.store(plan.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("key").alias("_k"), revisit.alias("original"), "copies"), "plan")
    if not skinny.where("copies > 1").isEmpty():
        pages = pages.dropDuplicates()
    pages = pages.withColumn("_key", F.sha2("payload", 256))
    pages = pages.join(plan, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("_key") == F.col("_k")))
    rows = pages.select("page_id", "url", "payload", "original", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                for record in records_of(row["page_id"], row["url"], row["payload"], row["original"], row["copies"], segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, data[start:at]
        at += 4


_FIELDS = ["record_id", "kind", "page_id", "segment", "origin", "total", "digest", "refers_to", "refers_page", "copies", "block"]
_RECORDS = "record_id string, kind string, page_id long, segment int, origin string, total long, digest string, refers_to string, refers_page long, copies int, block binary"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under `path` (plain or gzip)."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                rows = []
                size = 0
                for f, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    rows.append((f["warc-record-id"], f["warc-type"], number(f.get("x-page-id")), number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-total-length")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-refers-to"), number(f.get("x-refers-to-page-id")), int(f.get("x-copies", 1)), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_FIELDS)


def payload_of(block: bytes, digest: str | None) -> bytes:
    """The payload of an HTTP response block; raises ValueError if it doesn't have the digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest is not None and digest_of(payload) != digest:
        raise ValueError("a payload does not have its record's digest")
    return payload


_PAYLOADS = "record_id string, page_id long, copies int, payload binary, payload_digest string"


def payloads(records: DataFrame) -> DataFrame:
    """record_id, page_id, copies, payload, payload_digest of every response, segments put together."""

    def emit(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()], strict=True)], names=["record_id", "page_id", "copies", "payload", "payload_digest"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                payload = payload_of(r["block"], r["digest"])
                found.append((r["record_id"], r["page_id"], r["copies"], payload, digest_of(payload)))
            yield emit(found)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["of"]):
            found = []
            for a, b in bounds(batch, ["of"]):
                rows = batch.slice(a, b - a).to_pylist()
                if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
                    raise ValueError(f"segments of {rows[0]['of']} are missing or repeated")
                block = b"".join(r["block"] for r in rows)
                if rows[-1]["total"] != len(block):
                    raise ValueError(f"{rows[0]['of']} has {len(block)} bytes, not {rows[-1]['total']}")
                payload = payload_of(block, rows[0]["digest"])
                found.append((rows[0]["record_id"], rows[0]["page_id"], rows[0]["copies"], payload, digest_of(payload)))
            yield emit(found)

    alone = records.where("kind = 'response' and segment is null").select("record_id", "page_id", "copies", "digest", "block").mapInArrow(whole, _PAYLOADS)
    parts = records.where("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    parts = parts.select("of", "segment", "record_id", "page_id", "copies", "total", "digest", "block")
    parts = parts.repartition("of").sortWithinPartitions("of", "segment").mapInArrow(put_together, _PAYLOADS)
    return alone.union(parts)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives, read them back: one row per row.

    Returns page_id, payload_bytes, payload_digest, record_type (response or
    revisit) and refers_to (the response's page_id, for a revisit).  Null html
    is an empty payload; a null url has no target address; control characters
    in an address are percent-encoded.  Rows that repeat page, address and
    payload are one record that counts its copies.  A null page_id comes before
    all others; with equal page_ids all are responses.  Other columns are not
    read; an empty table gives an empty result.
    """
    small_batches(spark)
    with Scratch(spark, "warc") as scratch:
        path = scratch.path("archives")
        write_archives(spark, pages, path, scratch, least_revisit, segment_bytes)
        records = read_records(spark, path)
        found = payloads(records).select("record_id", "page_id", "copies", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
        found = scratch.store(found, "responses", keep=True)
        revisits = records.where("kind = 'revisit'").select("page_id", "copies", "digest", "refers_to", "refers_page")
        revisits = scratch.store(revisits, "revisits", keep=True)
    one = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    original = found.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = revisits.join(original, "refers_to").where("digest = payload_digest")
    responses = found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), one.alias("_one"))
    again = again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("refers_page").alias("refers_to"), one.alias("_one"))
    return responses.union(again).drop("_one")
