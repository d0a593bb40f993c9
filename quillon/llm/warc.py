"""WARC archives: written with one gzip member per record, read back one record at a time.

An archive image is a row of bytes (a whole .warc.gz file of bounded size), so it lives in any store Spark can write.
The reader inflates one member after another from a bounded window of input, frames each record by its
Content-Length and verifies the block and payload digests that it names (base 32 or 16 of SHA-1); it raises ValueError
on damage, and on a member that inflates beyond `most` bytes. It reads records of any type and any writer: ids that
aren't page ids stay null in record_id, and the text of every id is there as it was written.

Null html counts as empty. Of pages with equal payloads the one with the largest id is the response and the others
revisit it (rows that repeat that id are all responses); smaller payloads than `least` bytes are always responses.
Equality is that of SHA-1. Rows without an id are responses. Repeated rows give a record each. Columns other than
page_id, url and html are not read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

VERSION, LEVEL = b"WARC/1.1", 3
#: Bytes of an archive image before a new one starts, and of input that the reader holds.
ARCHIVE_BYTES, READ_BYTES = 256 << 10, 64 << 10
#: Bytes that one record may inflate to.
MEMBER_BYTES = 1 << 30
#: How a table of images is best written: they are compressed already, and a Parquet page holds few of them.
STORED = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "10"}
#: Records and bytes of payload that the reader hands on at once.
HAND_ROWS, HAND_BYTES = 200, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    text = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines)]) + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(text + block + b"\r\n\r\n") + deflate.flush()


def members(source: BinaryIO, most: int = MEMBER_BYTES) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time, each of at most `most` bytes."""
    held = b""
    while held or (held := source.read(READ_BYTES)):
        inflate, parts, size, starved = zlib.decompressobj(31), [], 0, True
        while not inflate.eof:
            if not held and not (held := source.read(READ_BYTES)) and starved:
                raise ValueError("the last gzip member is cut off")
            try:
                parts.append(inflate.decompress(held, READ_BYTES))
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
            size, starved = size + len(parts[-1]), len(parts[-1]) < READ_BYTES
            if size > most:
                raise ValueError(f"a member has more than {most} bytes")
            held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        yield b"".join(parts)


def fields(text: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in text.split(b"\r\n")[1:] if line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def agrees(named: str | None, data: bytes) -> bool:
    """Whether `data` has the digest that a header names; true without one, or with one by another algorithm."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return True
    return value.lower() == hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper().rstrip("=") == digest(data)


def read(source: BinaryIO, most: int = MEMBER_BYTES) -> Iterator[dict]:
    """Each record's headers, HTTP headers (of HTTP messages) and payload, framed and verified."""
    for member in members(source, most):
        if not member.startswith(b"WARC/"):
            raise ValueError("a member does not start with a WARC version")
        split = member.find(b"\r\n\r\n")
        if split < 0:
            raise ValueError("a record's headers do not end")
        head = fields(member[:split])
        start, said = split + 4, head.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,18}", said):
            raise ValueError(f"record {head.get('warc-record-id')}: no Content-Length")
        block = member[start : start + int(said)]
        if len(block) != int(said) or member[start + int(said) :] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')}: Content-Length doesn't frame the block")
        if not agrees(head.get("warc-block-digest"), block):
            raise ValueError(f"record {head.get('warc-record-id')}: the block digest differs")
        http = b"", block
        if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            http = block.partition(b"\r\n\r\n")[::2]
        if head.get("warc-type") != "revisit" and not agrees(head.get("warc-payload-digest"), http[1]):
            raise ValueError(f"record {head.get('warc-record-id')}: the payload digest differs")
        yield {"head": head, "http": fields(http[0]), "payload": http[1]}


def archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """warc binary: archive images of all pages; the columns page_id, url and html are read."""
    spark = pages.sparkSession
    bounded_batches(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumn("sha", F.unhex(F.sha1("html")))
    groups = keyed.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.min("page_id").alias("low")).filter("first <> low").select(F.col("sha").alias("of"), "first")
    joined = keyed.join(groups, F.col("sha") == F.col("of"), "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode(), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["warc"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["warc"])

    return joined.mapInArrow(write, "warc binary")


def page(named: str | None) -> int | None:
    """The page id in a record id of archives(), else null."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", named or "")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def records(images: DataFrame, column: str = "warc", payloads: bool = True) -> DataFrame:
    """record_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, record_name: all records of archive images.

    Works on the table of archives() or on spark.read.format("binaryFile") with column="content". A revisit's payload
    is null; its length is that of the HTTP head it keeps. Without `payloads` all are null, verified nonetheless. Null
    images have no records; what a record's headers don't say is null.
    """
    bounded_batches(images.sparkSession)

    def length(r: dict) -> int | None:
        if r["head"].get("warc-type") != "revisit":
            return len(r["payload"])
        said = r["http"].get("content-length", "")
        return int(said) if re.fullmatch(r"[0-9]{1,18}", said) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = ["record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "record_name"]
        for batch in batches:
            for image in batch.column(0):
                rows, size = [], 0
                for r in read(io.BytesIO(image.as_py() or b"")):
                    h = r["head"]
                    body = r["payload"] if payloads and h.get("warc-type") != "revisit" else None
                    named = h.get("warc-payload-digest")
                    rows.append((page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), named and named.removeprefix("sha1:"), length(r), page(h.get("warc-refers-to")), body, h.get("warc-record-id")))
                    size += len(body or b"")
                    if len(rows) >= HAND_ROWS or size >= HAND_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return images.select(column).mapInArrow(run, "record_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, record_name string")
