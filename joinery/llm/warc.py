"""WARC writing with identical-payload revisits, and a sequential reader (operator 3).

Writer: one gzip member a record, so archives can be cut and joined at members.
Of rows with equal payloads the smallest page_id is the response; the others
are revisits, which hold no payload and name the response.

Reader: feeds compressed bytes to one zlib decompressor a member, frames the
block by Content-Length, and verifies the digests: the block's, and a response's payload's.

Defined results: null html is an empty payload; empty payloads are equal to
each other; a null page_id comes after all others; rows equal in page_id, url
and payload are all responses if the first is; an empty table gives no archives and no rows; a payload may
be as long as a value can be (it is held once, with its compressed form); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .tokenfiles import file_system, local_uri, put

#: Fixed values of the format and of this writer.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF, DATE, ARCHIVE_BYTES, LEVEL = b"\r\n", "1970-01-01T00:00:00Z", 32 << 20, 6


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    block = b"" if revisit else payload
    name = "" if page_id is None else str(page_id)
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    own = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return own.compress("\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2) + own.flush()


class BadRecord(ValueError):
    pass


def _members(stream, size: int) -> Iterator[bytes]:
    """Each gzip member's content; compressed bytes are read ``size`` at a time."""
    rest = stream.read(size)
    while rest:
        own, out = zlib.decompressobj(31), []
        while not own.eof:
            if not rest:
                raise BadRecord("the archive ends inside a member")
            out.append(own.decompress(rest))
            rest = own.unused_data if own.eof else stream.read(size)
        yield b"".join(out)
        rest = rest or stream.read(size)


def records(stream, size: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record, digests verified."""
    for content in _members(stream, size):
        head, found, body = content.partition(CRLF * 2)
        first, *lines = head.decode().split("\r\n")
        if not found or first != VERSION:
            raise BadRecord(f"no record begins with {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        if body[n:] != CRLF * 2:
            raise BadRecord("the block is not as long as Content-Length says")
        block = body[:n]
        wanted = {"warc-block-digest"} | ({"warc-payload-digest"} if fields["warc-type"] == "response" else set())
        if any(fields[k] != f"sha1:{digest(block)}" for k in wanted):
            raise BadRecord(f"digest of {fields.get('warc-record-id')}")
        yield fields, block


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and of the rows with equal html the first page_id and url; only small rows meet by payload."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.withColumn("_sha", F.unhex(F.sha2("html", 256)))
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    first = own.groupBy("_sha").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", "_first")
    return own.join(first, "_sha", "left").drop("_sha")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives under names of the attempt's own. Returns one row an archive: path and n_records; other files in the folder are of lost attempts."""
    folder = local_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seq, out, n = TaskContext.get(), 0, [], 0
        part, attempt = context.partitionId(), context.taskAttemptId()

        def flush() -> pa.RecordBatch:
            path = put(folder, f"part-{part:06d}-{seq:04d}-{attempt}.warc.gz", b"".join(out))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(out)])], names=["path", "n_records"])

        for b in batches:
            for at, to, _, _ in words.parts(b.column("html"), 8 << 20):
                for r in b.slice(at, to - at).to_pylist():
                    first = r["_first"]
                    revisit = first is not None and (first["page_id"], first["url"]) != (r["page_id"], r["url"] or "")
                    out.append(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), first["page_id"] if revisit else None, revisit))
                    n += len(out[-1])
                    if n >= ARCHIVE_BYTES:
                        yield flush()
                        out, n, seq = [], 0, seq + 1
        if out:
            yield flush()

    return with_first(pages).sortWithinPartitions("page_id").mapInArrow(common.tidy(run), "path string, n_records long")


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row a record of the archives named in column path; ``payload`` is null for revisits, or if not asked for."""
    whole = lambda x: int(x) if x not in (None, "", "None") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for f, block in records(stream):
                        revisit = f["warc-type"] == "revisit"
                        keep = block.decode("utf-8", "replace") if payload and not revisit else None
                        rows.append((whole(f["x-page-id"]), f["warc-target-uri"], int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], whole(f.get("x-refers-to")), keep))
                        size += len(keep or "")
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return archives.select("path").mapInArrow(common.tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def digests(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    # what finished attempts wrote, as a table: nothing is collected, and a recomputed read finds the same archives
    archives = common.materialise(write(pages, common.scratch(spark, "warc")), "archives")
    archives = archives.repartition(common.shuffle_parts(spark), "path")
    return read(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
