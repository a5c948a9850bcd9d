"""WARC records in ZIP packages: written one package per task, read back by ranges without extraction.

A package is a ZIP archive with stored (never deflated) members: archive/data.warc.gz, in which every record is a gzip
member of its own, and indexes/index.cdxj, a line per record with its offset and length inside that member. A reader parses
the end of the archive for the central directory (ZIP64 fields included), reads the index member, and then only those
ranges of the archive that hold the records it wants.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import join_counted, scratch_path, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed at this size and the task goes on with another; a range read takes about this much at most.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 1 << 20


class ArchiveError(ValueError):
    """Bytes that are no such archive, directory or record."""


@dataclass(frozen=True)
class Member:
    """A member of an archive: name, compression method (0: stored), sizes, and where its local header begins."""

    name: str
    method: int
    packed: int
    size: int
    header: int


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds path (file, hdfs, s3, gs ...) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """wanted (size, packed, offset), those at their 32-bit limit taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, out = extra[at + 4 : at + 4 + n], []
            for x in wanted:
                if x == 0xFFFFFFFF:
                    if len(field) < 8:
                        raise ArchiveError("short ZIP64 field")
                    x, field = struct.unpack_from("<Q", field)[0], field[8:]
                out.append(x)
            return out
        at += 4 + n
    return wanted


def directory(f: BinaryIO) -> list[Member]:
    """The members that the central directory of an archive lists, by its end records (ZIP64 too); f: seekable."""
    size = f.seek(0, 2)
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(tail):
        raise ArchiveError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        f.seek(tail_at + end - 20)
        locator = f.read(20)
        if locator[:4] != b"PK\x06\x07":
            raise ArchiveError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", locator, 8)[0])
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ArchiveError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    f.seek(at)
    raw, members, at = f.read(length), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ArchiveError("bad central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n, e, c = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _zip64(raw[at + 46 + n : at + 46 + n + e], [full, packed, header])
        members.append(Member(name, method, packed, full, header))
        at += 46 + n + e + c
    return members


def data_offset(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin in the archive."""
    if member.method != 0:
        raise ArchiveError(f"{member.name} is not stored")
    f.seek(member.header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ArchiveError("bad local header")
    n, e = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n + e


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers.items(), ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ArchiveError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ArchiveError("short WARC record")
    return headers, block


class PackageWriter:
    """One package, written from front to back; the index waits in memory, a short line per record."""

    def __init__(self, sink: BinaryIO):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, raw: bytes, entry: dict) -> None:
        tool = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = tool.compress(raw) + tool.flush()
        self.data.write(packed)
        self.lines.append(json.dumps(entry | {"offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()


def _one_line(url: str | None) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")


def _write(folder: str):
    """Rows (key, url, payload, first) to packages in folder; a row (path) for each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_path(folder)
        where.create_dir(root, recursive=True)
        writer = sink = name = None

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            where.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for key, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                key, url, payload, first = key.as_py(), url.as_py(), payload.as_py() or b"", first.as_py()
                if writer is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"
                    sink = where.open_output_stream(f"{root}/.{name}")
                    writer = PackageWriter(sink)
                digest, kind = base32_sha1(payload), "response" if first is None or first == key else "revisit"
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Target-URI": _one_line(url), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                if kind == "revisit":
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>"}
                writer.add(record(headers, http + (payload if kind == "response" else b"")), {"id": key, "type": kind, "digest": digest})
                if writer.at >= PACKAGE_BYTES:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return run


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0) -> DataFrame:
    """Write a record per row of pages to packages in folder, a fresh path that all executors share; a row (path) for each.

    Of the rows whose UTF-8 payloads (null: empty) are equal and of at least min_payload bytes, one with the largest key is
    a response and the others are revisits of it; smaller payloads are all responses. Equal means equal SHA-256. Only packages
    of tasks that succeeded are listed, so a repeated or lost task adds nothing. Rows that share one key: all of
    them are responses if their key is the largest. A null key is written as None and never refers.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    groups = table(rows.where(F.length("payload") >= min_payload).groupBy("sha").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    # Payloads stay where they are while groups are few; the payloads of a crowded group always do.
    joined = join_counted(rows, groups, "sha", "n", "left").select("key", "url", "payload", "first")
    return table(joined.mapInArrow(_write(folder), "path string"))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages (path) to ranges of whole records: path, start, length, and the records' lengths."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, at = open_path(path)
            with where.open_input_file(at) as f:
                members = {m.name: m for m in directory(f)}
                index, data = members[INDEX], members[DATA]
                begin = data_offset(f, index)
                f.seek(begin)
                entries = sorted((e["offset"], e["length"]) for e in map(json.loads, f.read(index.size).splitlines()))
                begin = data_offset(f, data)
            rows: list[list] = []
            for offset, length in entries:
                if rows and rows[-1][1] + rows[-1][2] == begin + offset and rows[-1][2] + length <= RANGE_BYTES:
                    rows[-1][2] += length
                    rows[-1][3].append(length)
                else:
                    rows.append([path, begin + offset, length, [length]])
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "length", "records"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("records", pa.list_(pa.int64()))]))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to records: key, type, payload, digest, refers_to."""
    schema = pa.schema([("key", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("payload", pa.large_binary()), ("digest", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, start, length, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            where, at = open_path(path)
            with where.open_input_file(at) as f:
                f.seek(start)
                raw = memoryview(f.read(length))
            rows, to = [], 0
            for n in records:
                headers, block = parse_record(zlib.decompress(raw[to : to + n], 31))
                to += n
                payload = block.partition(b"\r\n\r\n")[2]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and base32_sha1(payload) != digest:
                    raise ArchiveError("payload digest does not match")
                ids = [headers[h][len("<urn:page:") : -1] if h in headers else None for h in ("warc-record-id", "warc-refers-to")]
                key, refers = (None if x in (None, "None") else int(x) for x in ids)
                rows.append((key, headers["warc-type"], headers["warc-target-uri"], payload, digest, refers))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of packages (path string): key long, type, url, payload binary, digest, refers_to long.

    The payload of a revisit is empty, as it was stored. No package has no records.
    """
    spark = packages.sparkSession
    ranges = table(packages.repartition("path").mapInArrow(_index, "path string, start long, length long, records array<long>"))
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(wide, "path", "start").mapInArrow(_records, "key long, type string, url string, payload binary, digest string, refers_to long")


def archive_and_read(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to packages in the shared folder and read the records back, with the length of the full payload of each, which for a revisit is that of the record it refers to: key, type, url, payload_bytes, digest, refers_to."""
    records = read_packages(write_packages(pages, scratch_path(pages.sparkSession), min_payload=min_payload))
    narrow = table(records.select("key", "type", "url", F.length("payload").cast("long").alias("own"), "digest", "refers_to"))
    full = narrow.where("type = 'response'").groupBy(F.col("key").alias("refers_to"), "digest").agg(F.max("own").alias("full"))
    # A record that very many refer to is joined with them where they lie.
    referred = narrow.where("type = 'revisit'").groupBy("refers_to", "digest").agg(F.count("*").alias("n"))
    sizes = table(referred.join(full, ["refers_to", "digest"]))
    both = join_counted(narrow, sizes, ["refers_to", "digest"], "n", "left")
    return both.select("key", "type", "url", F.coalesce("full", "own").alias("payload_bytes"), "digest", "refers_to")
