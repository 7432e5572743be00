"""WARC archives as a chunked record table.

A record is rows of (record id, chunk number): oversized payloads travel as chunks, each with
the running SHA-1 and byte count up to its end, so neither side holds a record beyond a chunk
(a cell of the input is one in the JVM; it is cut there, and workers see chunks only).
Writing carries the SHA-1 from chunk to chunk and compares it with the declared one at the end; it makes one WARC record of each chunk (the first carries the type, the others are
``continuation`` segments, as WARC 1.1 has it), through Spark's own text writer: files are
committed by tasks, on any file system that Spark writes.  A row ends with CR LF CR LF, which
is how a WARC record ends.  Archives are gzip files, so each is read by one task in order;
reading goes through Spark's text reader line by line and gives the chunk table back.

Defined cases: a null payload is empty (0 bytes); a null key is written as ``null`` and
read as null; repeated rows are records of their own; line breaks and control characters in a URI
are percent-encoded; other columns are ignored; an empty table gives empty archives.  A record
whose archive ends too early is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, written

CHUNK_BYTES = 1 << 20
LEAST_REVISIT = 1_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, record_type string, refers_to long, chunk_no int, n_bytes long, total_bytes long, digest string, last boolean, payload binary"
SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("n_bytes", pa.int64()), ("total_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("payload", pa.binary())]
)
BATCH_BYTES = 4 << 20


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _segment_name(page_id: int | None, number: int) -> str:
    return _name(page_id) if number == 1 else f"{_name(page_id)[:-1]}:segment:{number}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def segment(page_id: int | None, url: str | None, number: int, count: int, piece: bytes, size: int, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """The WARC record of one chunk (``number`` from 1 of ``count``) of one page, without the closing CR LF CR LF."""
    kind = "revisit" if is_revisit else "response"
    head = [VERSION.decode(), f"WARC-Type: {kind if number == 1 else 'continuation'}", f"WARC-Record-ID: {_segment_name(page_id, number)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if number == 1:
        head += [f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
        if is_revisit:
            head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    else:
        head.append(f"WARC-Segment-Origin-ID: {_name(page_id)}")
    if count > 1:
        head.append(f"WARC-Segment-Number: {number}")
        if number == count:
            head.append(f"WARC-Segment-Total-Length: {len(HTTP_HEAD) + size}")
    front = HTTP_HEAD if number == 1 else b""
    head.append(f"Content-Length: {len(front) + len(piece)}")
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", front, piece])


def record_segments(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The WARC records, one a chunk, of one page that is at hand as a whole."""
    pieces = [b""] if is_revisit else [payload[at : at + chunk] for at in range(0, len(payload), chunk)] or [b""]
    for number, piece in enumerate(pieces, 1):
        yield segment(page_id, url, number, len(pieces), piece, len(payload), digest, refers_to, is_revisit)


def chunk_rows(records: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Records (``payload`` and others) as a row for each chunk, in order: ``number``, ``count`` and ``piece`` instead of the payload; an empty or null one has one empty chunk."""
    held = F.coalesce("payload", F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.length(held) / chunk).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), count), lambda n: F.struct(n.alias("number"), F.substring(held, (n - 1) * chunk + 1, F.lit(chunk)).alias("piece")))
    return records.select(*[c for c in records.columns if c != "payload"], count.alias("count"), F.inline(cut))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write gzip WARC archives of all rows to ``path``.

    Of rows whose equal payloads have ``LEAST_REVISIT`` bytes or more, those with the largest key
    are responses, the others revisits of it.  Only digests are aggregated; a revisit's payload
    isn't written.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= LEAST_REVISIT
    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).cast("string").cast("binary").alias("payload"))
    owners = held.filter(large & F.col("page_id").isNotNull()).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    owners = written(owners, "payload-owners")
    told = rows.join(owners, "digest", "left").withColumn("is_revisit", F.coalesce(large & (F.col("owner").isNull() | F.col("page_id").isNull() | (F.col("page_id") < F.col("owner"))) & F.col("owner").isNotNull(), F.lit(False)))
    told = told.select("page_id", "url", F.when(~F.col("is_revisit"), F.col("payload")).alias("payload"), F.length("payload").alias("size"), "digest", F.when(F.col("is_revisit"), F.col("owner")).alias("refers_to"), "is_revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held, running = [], 0, hashlib.sha1(usedforsecurity=False)
        for batch in batches:
            names = batch.schema.names
            for row in zip(*batch.columns, strict=True):
                got = dict(zip(names, (x.as_py() for x in row), strict=True))
                if got["number"] == 1:
                    running = hashlib.sha1(usedforsecurity=False)
                running.update(got["piece"])
                if got["number"] == got["count"] and not got["is_revisit"] and running.hexdigest() != got["digest"]:
                    raise ValueError(f"the chunks of page {got['page_id']} are not its payload")
                ready.append(segment(**got))
                held += len(ready[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], ["value"])
                    ready, held = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], ["value"])

    bounded_batches(pages.sparkSession)
    records = chunk_rows(told).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


@dataclass
class _Reader:
    """Reads one archive line by line; gives chunk rows."""

    chunk: int = CHUNK_BYTES
    head: dict[str, str] | None = None
    left: int = 0
    skip: int = 0
    buffer: bytearray = field(default_factory=bytearray)
    record: dict | None = None

    def line(self, line: bytes) -> Iterator[tuple]:
        """``line`` comes without its line feed, which is a byte of the archive too."""
        if self.left:
            data = line + b"\n"
            if len(data) > self.left:
                data, rest = data[: self.left], data[self.left :]
            else:
                rest = b""
            self.left -= len(data)
            yield from self._body(data)
            if self.left == 0:
                yield from self._end_block()
            if rest.strip(b"\r\n"):
                raise ValueError("a record is longer than it says")
            return
        text = line.rstrip(b"\r")
        if self.head is None:
            if text.startswith(b"WARC/"):
                self.head = {}
            elif text:
                raise ValueError(f"no record starts with {text[:40]!r}")
        elif text:
            key, _, value = text.decode().partition(":")
            self.head[key.strip().lower()] = value.strip()
        else:
            yield from self._start_block()

    def _start_block(self) -> Iterator[tuple]:
        head = self.head
        number = int(head.get("warc-segment-number", "1"))
        if number == 1:
            yield from self._flush(True)
            refers = head.get("warc-refers-to")
            self.record = {
                "page_id": _id_of(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": _id_of(refers) if refers else None, "no": 0, "total": 0,
                "sha": hashlib.sha1(usedforsecurity=False), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "told": int(head.get("x-payload-length", "-1")),
            }
        self.more = "warc-segment-number" in head and "warc-segment-total-length" not in head
        self.in_http = number == 1 and "application/http" in head.get("content-type", "")
        self.last_line = bytearray()
        self.left = int(head["content-length"])
        if self.left == 0:
            yield from self._end_block()

    def _body(self, data: bytes) -> Iterator[tuple]:
        if self.in_http:
            if data.strip(b"\r\n") == b"" and data.endswith(b"\n"):
                self.in_http = False
            return
        self.buffer += data
        while len(self.buffer) > self.chunk:
            piece = bytes(self.buffer[: self.chunk])
            del self.buffer[: self.chunk]
            yield self._chunk(piece, False)

    def _end_block(self) -> Iterator[tuple]:
        self.head = None
        if not self.more:
            yield from self._flush(True)

    def _chunk(self, piece: bytes, last: bool) -> tuple:
        r = self.record
        r["sha"].update(piece)
        r["total"] += len(piece)
        r["no"] += 1
        revisit = r["record_type"] == "revisit"
        if last and not revisit and r["digest"] and r["digest"] != r["sha"].hexdigest():
            raise ValueError(f"the payload of page {r['page_id']} differs from its digest")
        return (r["page_id"], r["record_type"], r["refers_to"], r["no"] - 1, len(piece), r["told"] if revisit else r["total"], r["digest"] if revisit else r["sha"].hexdigest(), last, piece)

    def _flush(self, last: bool) -> Iterator[tuple]:
        if self.record is not None:
            yield self._chunk(bytes(self.buffer), last)
            self.buffer.clear()
            self.record = None

    def close(self) -> None:
        if self.left or self.record is not None:
            raise ValueError("an archive ends within a record")


def _id_of(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "null" else int(number)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives in ``path``: a row a chunk, in order within a record.

    ``digest`` and ``total_bytes`` run with the chunks; where ``last``, they are the whole
    payload's.  A revisit is one row, with the digest and length it was written with.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, ready, held = _Reader(), None, [], 0
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != now:
                    reader.close()
                    reader, now = _Reader(), file
                for row in reader.line(line.as_py()):
                    ready.append(row)
                    held += row[4] + 100
                if held >= BATCH_BYTES:
                    yield _rows(ready)
                    ready, held = [], 0
        reader.close()
        if ready:
            yield _rows(ready)

    return lines.mapInArrow(run, FIELDS)


def _rows(ready: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
