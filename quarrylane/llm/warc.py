"""Converter from legacy ARC archives to WARC.

ARC files begin with a version block that names the fields of every record line: version 1 has five (URL, IP address, date,
content type, length), version 2 has ten. The reader takes the field names from that block, reads as many bytes as each
record line declares, and hands on what it found. The converter gives each record a WARC identifier (a UUID of its page and
date), an ISO date, a type and SHA-1 digests. Of equal payloads the one with the smallest page id is a response; the others
revisit it and carry no payload, but its digest and length.

Archives are written by Spark's text writer, one file per partition, gzipped, in the shared folder: a record's end (a line
feed in ARC, two CRLF in WARC) is the writer's line separator, so lost tasks are written again under its commit protocol and
nothing opens a path by itself. They are read as binary files, one row each, whose size the number of partitions bounds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import join_counted, partition_count, saved, shared_folder

#: Field names of the record line, by version; fixed by the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {}\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of decompressed records that one Arrow batch may hold before it is handed on.
_BATCH = 8 << 20

_PRINTABLE = "".join(chr(c) for c in range(33, 127))
RECORD = "page_id string, url string, ip string, date string, mime string, payload binary, key string, at long"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _token(text: str | None) -> str:
    """A value of a space-separated line: white space, control and non-ASCII characters percent-encoded, nothing as ``-``."""
    return quote(text or "", safe=_PRINTABLE) or "-"


def arc_block(version: int, date: str) -> bytes:
    """The version block, without the separator after it."""
    body = f"{version} 0 quarry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return _arc_line(version, "filedesc://records.arc", "0.0.0.0", date, "text/plain", len(body)).encode() + b"\n" + body


def _arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int) -> str:
    if version == 1:
        return f"{url} {ip} {date} {mime} {length}"
    return f"{url} {ip} {date} {mime} 200 - - 0 records.arc {length}"


def _written(rows: DataFrame, what: str, end: str) -> str:
    """Binary records written as they are, with ``end`` after each; the folder."""
    path = shared_folder(rows.sparkSession, what)
    rows.select(F.col("record").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(path)
    return path


def write_arc(pages: DataFrame, date: str = "20240101000000") -> str:
    """ARC files of pages (``page_id``, ``url``, ``html``), version 1 and 2 by turns; the folder.

    Null html is an empty payload. The page id travels in the archived HTTP header, as ARC has no field for it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        first = [arc_block(version, date)]
        for batch in batches:
            out = []
            for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2)):
                page_id = page.as_py()
                body = _HTTP.format("" if page_id is None else page_id).encode() + (html.as_py() or "").encode()
                out.append(_arc_line(version, _token(url.as_py()), "0.0.0.0", date, "text/html", len(body)).encode() + b"\n" + body)
            yield pa.RecordBatch.from_arrays([pa.array(first + out, pa.binary())], names=["record"])
            first = []

    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return _written(rows.mapInArrow(run, "record binary"), "arc", "\n")


class _Bytes:
    """Bytes of a gzip file, one or many members, decompressed as they are asked for."""

    def __init__(self, content: memoryview):
        self.content, self.at = content, 0
        self.plain = bytes(content[:2]) != b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at:self.at + (1 << 18)]
        self.at += len(part)
        if self.plain:
            self.held += part
            return True
        while len(part):
            self.held += self.unzip.decompress(part)
            part = memoryview(self.unzip.unused_data) if self.unzip.eof else b""
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed over; None at the end."""
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[:k])
        del self.held[:k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"the archive ends {n - len(self.held)} bytes before a record's declared length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_arc(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Record lines by field name, and the declared bytes, of one ARC file of either version."""
    data, fields = _Bytes(content), None
    while True:
        line = data.until(b"\n")
        while line is not None and not line.strip():
            line = data.until(b"\n")
        if line is None:
            return
        parts = line.decode("utf-8", "replace").split(" ")
        body = data.take(int(parts[-1]))
        if fields is None:
            version, names = body.split(b"\n")[:2]
            fields = tuple(names.decode().split(" "))
            if fields != ARC_FIELDS.get(int(version.split(b" ")[0])):
                raise ValueError(f"unknown ARC version block {body[:100]!r}")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"a record line has {len(parts)} fields, its version has {len(fields)}")
        yield dict(zip(fields, parts)), body


def parse_warc(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of one WARC file."""
    data = _Bytes(content)
    while (head := data.until(b"\r\n\r\n")) is not None:
        first, *lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:100]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        yield fields, data.take(int(fields["Content-Length"]))
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end in two line ends")


def _http(block: bytes) -> tuple[str | None, bytes]:
    """Page id and payload of an archived HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return named.get("X-Page-Id") or None, payload


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def _parsed(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of each archive, handed on in batches of bounded bytes."""
    kind = pa.schema([(n.split(" ")[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[n.split(" ")[1]]) for n in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row, weight in rows_of(memoryview(content.as_buffer())):
                    held.append(row)
                    size += weight
                    if size >= _BATCH or len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)

    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files below a folder."""
    def rows_of(content: memoryview):
        for at, (line, block) in enumerate(parse_arc(content)):
            page_id, payload = _http(block)
            yield (page_id, line["URL"], line["IP-address"], line["Archive-date"], line["Content-type"], payload, _key(payload), at), len(payload)

    return _parsed(_binary(spark, path), rows_of, RECORD)


def _key(payload: bytes) -> str:
    return f"{payload_digest(payload)}:{len(payload)}"


def arc_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``key`` (payload digest and bytes) and ``bytes`` of all ARC records, without the payloads."""
    def rows_of(content: memoryview):
        for _, block in parse_arc(content):
            page_id, payload = _http(block)
            yield (page_id, _key(payload), len(payload)), 64

    return _parsed(_binary(spark, path), rows_of, "page_id string, key string, bytes long")


def record_id(page_id: str | None, date: str) -> str:
    """The same page of the same date always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}@{date}')}>"


def iso_date(date: str) -> str:
    """Fourteen digits as WARC has them; shorter ARC dates are filled up."""
    d = date.ljust(14, "0")[:14] if len(date) != 8 else date + "000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(page_id: str | None, url: str, ip: str, date: str, mime: str, payload: bytes, refers: str | None, repeats: bool) -> bytes:
    """One record without the separator after it; a revisit names the page that it repeats."""
    head = [("WARC-Type", "revisit" if repeats else "response"), ("WARC-Record-ID", record_id(page_id, date)), ("WARC-Date", iso_date(date)),
            ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
            ("WARC-Identified-Payload-Type", mime), ("X-Payload-Length", len(payload)), ("X-Page-Id", page_id or "")]
    http = _HTTP.format(page_id or "").encode()
    if repeats:
        block = http
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, date)), ("X-Refers-To-Page-Id", refers or "")]
    else:
        block = http + payload
    head += [("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def repeated_payloads(payloads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``key`` and ``refers`` (smallest page id of equal payloads) of the records that are to be revisits.

    Numbers are compared as numbers. Records that repeat the smallest page id itself stay responses, as do null ids.
    """
    rows = saved(payloads.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "key", F.col("page_id").try_cast("long").alias("number")))
    first = rows.groupBy("key").agg(F.min("number").alias("number"), F.min("page_id").alias("text"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = saved(first.select("key", F.coalesce(F.col("number").cast("string"), "text").alias("refers"), "n"))
    same = join_counted(rows, first, "key", "n")
    return same.where("page_id != refers").select("page_id", "key", "refers").distinct()


def convert(spark: SparkSession, arc: str, least_bytes: int = 0) -> str:
    """WARC files of all ARC records below a folder; the new folder."""
    revisits = repeated_payloads(arc_payloads(spark, arc), least_bytes).withColumnRenamed("page_id", "id")
    # A record without a page id meets no revisit; its place in its file spreads such records.
    rows = read_arc(spark, arc).withColumn("id", F.coalesce("page_id", F.concat(F.lit("\n"), F.col("at").cast("string"))))
    rows = rows.join(revisits.withColumn("repeats", F.lit(True)), ["id", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: quarry\r\nformat: WARC File Format 1.0\r\n"
        head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, 'info')}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        first = [head.encode() + info]
        for batch in batches:
            out = [warc_record(*(c.as_py() for c in row[:5]), row[5].as_py() or b"", row[6].as_py(), bool(row[7].as_py())) for row in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(first + out, pa.binary())], names=["record"])
            first = []

    made = rows.select("page_id", "url", "ip", "date", "mime", "payload", "refers", "repeats").mapInArrow(run, "record binary")
    return _written(made, "warc", WARC_END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page of all WARC files below a folder, its payload checked against its digest and length."""
    def rows_of(content: memoryview):
        for fields, block in parse_warc(content):
            if fields["WARC-Type"] == "warcinfo":
                continue
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            if kind == "response":
                _, payload = _http(block)
                if payload_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"]):
                    raise ValueError(f"{fields['WARC-Record-ID']} doesn't match its digest")
            yield (fields["X-Page-Id"] or None, int(fields["X-Payload-Length"]), digest, kind, fields.get("X-Refers-To-Page-Id") or None, fields["WARC-Record-ID"]), 512

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string"
    return _parsed(_binary(spark, path), rows_of, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page.

    Null html is an empty payload, a null URL is written as ``-``; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = read_warc(spark, convert(spark, write_arc(pages.select("page_id", "url", "html"))))
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"), "record_id")
