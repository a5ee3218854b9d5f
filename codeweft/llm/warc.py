"""WARC records in ZIP archives: written by tasks, read back by byte ranges, never extracted.

An archive is a ZIP file whose members are stored, not deflated: a WARC file of
records, each its own gzip member, and a CDXJ index with a record's place on
each line. The reader parses the end record (ZIP64's too, where one is needed)
and the central directory, finds the members inside the archive, reads the
index and then only the ranges of records. Files go through Arrow's file
systems, so a shared folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from codeweft.llm.common import fresh_path, staged

#: Signatures and "see ZIP64" marks of the ZIP format.
LOCAL, CENTRAL, EOCD, EOCD64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Uncompressed bytes of records after which a task closes its archive, and indexed records read as one range.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Fixed value: the profile of a revisit with the same payload (WARC 1.1).
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


@dataclass
class Record:
    """A WARC record: named fields, and for responses the payload after the HTTP header."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean(value: str) -> str:
    """value without line ends, which would end a header line."""
    return " ".join(value.split())


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record, gzipped: a response with its payload, or a revisit of another page's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def header(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def read_record(data: bytes) -> Record:
    """The record of one gzip member."""
    raw = gzip.decompress(data)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = header(top)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, header(http), payload)


# ---------------------------------------------------------------- archives


class ZipWriter:
    """Writes stored members to a stream that can't seek; sizes follow in data descriptors, ZIP64 where 32 bits don't do."""

    def __init__(self, out, force64: bool = False) -> None:
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: Iterator[bytes]) -> None:
        start, crc, size, raw = self.at, 0, 0, name.encode()
        # bit 3: sizes and checksum follow the data; the extra field announces that they have 64 bits
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            self._put(chunk)
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))
        self.members.append((raw, start, crc, size))

    def close(self) -> None:
        begin = self.at
        for raw, start, crc, size in self.members:
            big = self.force64 or size >= FULL32 or start >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            small = (FULL32, FULL32, FULL32) if big else (size, size, start)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, *small[:2], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.force64 or begin >= FULL32 or n >= FULL16:
            end = self.at
            self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, n, n, size, begin, 0))


class ZipReader:
    """Finds stored members of a ZIP file that is read by ranges: read_at(start, length) of a file of size bytes."""

    def __init__(self, read_at, size: int) -> None:
        self.read_at = read_at
        tail_at = max(0, size - 22 - FULL16)
        tail = read_at(tail_at, size - tail_at)
        k = tail.rfind(EOCD)
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(EOCD, 0, k)
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        n, length, begin = struct.unpack_from("<HII", tail, k + 10)
        if n == FULL16 or FULL32 in (length, begin):
            mark = read_at(tail_at + k - 20, 20) if tail_at + k >= 20 else b""
            if mark[:4] == LOCATOR64:
                end = read_at(struct.unpack_from("<Q", mark, 8)[0], 56)
                if end[:4] != EOCD64:
                    raise ValueError("no ZIP64 end record where its locator points")
                n, length, begin = struct.unpack_from("<QQQ", end, 32)
        self.members = {m[0]: m[1:] for m in self._directory(read_at(begin, length), n)}

    def _directory(self, data: bytes, n: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(name, method, size, place of the local header, checksum) of each entry."""
        at = 0
        for _ in range(n):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, name_n, extra_n, note_n = struct.unpack_from("<IIIHHH", data, at + 16)
            start = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = data[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # ZIP64: only the values that are full above, in this order
                    wide = list(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    start = wide.pop(0) if start == FULL32 else start
                k += 4 + m
            yield name, method, packed, start, crc
            at += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's data inside the file."""
        method, size, start, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed (method {method}); only stored members can be read by ranges")
        local = self.read_at(start, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        name_n, extra_n = struct.unpack_from("<HH", local, 26)
        return start + 30 + name_n + extra_n, size

    def member(self, name: str) -> bytes:
        at, size = self.locate(name)
        return self.read_at(at, size)


def write_archive(folder: str, records: Iterator[tuple[dict, bytes]]) -> tuple[str, int, int]:
    """(path, records, bytes) of a new archive in folder with these (index entry, gzipped record)."""
    fs, base = open_folder(folder)
    path, index, place = f"{base}/{uuid.uuid4().hex}.wacz", [], 0

    def data() -> Iterator[bytes]:
        nonlocal place
        for entry, record in records:
            index.append(json.dumps(entry | {"offset": place, "length": len(record)}))
            place += len(record)
            yield record

    with fs.open_output_stream(path) as out:
        z = ZipWriter(out)
        z.member(WARC_MEMBER, data())
        z.member(INDEX_MEMBER, iter(["\n".join(index).encode()]))
        z.close()
    return path, len(index), place


def read_archive(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict, Record]]:
    """(index entry, record) of each record; records that follow one another are read together, RANGE_BYTES at once."""
    with fs.open_input_file(path) as f:
        z = ZipReader(lambda at, n: f.read_at(n, at), f.size())
        begin, _ = z.locate(WARC_MEMBER)
        entries = [json.loads(x) for x in z.member(INDEX_MEMBER).splitlines()]
        k = 0
        while k < len(entries):
            first, last = k, k
            while last + 1 < len(entries) and entries[last + 1]["offset"] == entries[last]["offset"] + entries[last]["length"] and entries[last + 1]["offset"] + entries[last + 1]["length"] - entries[first]["offset"] <= RANGE_BYTES:
                last += 1
            at = entries[first]["offset"]
            data = memoryview(f.read_at(entries[last]["offset"] + entries[last]["length"] - at, begin + at))
            for e in entries[first : last + 1]:
                yield e, read_record(bytes(data[e["offset"] - at : e["offset"] - at + e["length"]]))
            k = last + 1


# ---------------------------------------------------------------- Spark


def with_originals(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest other id with an equal payload, null if there is none smaller.

    Payloads are compared by SHA-1. Sums by digest are made before the shuffle, and
    only ids of payloads that occur twice are joined; a null payload is empty. A
    null id is never referred to and is a response unless another id has the payload.
    """
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    least = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))
    return rows.join(least, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, records, bytes) of the archives written to folder, a WARC record for each row of pages.

    Rows that repeat an id with the same payload are all responses or all revisits.
    A task that is run again writes a new archive; only the list returned counts.
    """
    source = with_originals(pages, page, url, html)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*[b.column(k) for k in range(5)], strict=True))
        pending, done = next(stream, None), []

        def records() -> Iterator[tuple[dict, bytes]]:
            nonlocal pending
            size = 0
            while pending is not None and size < ARCHIVE_BYTES:
                page_id, address, payload, digest, first = (x.as_py() for x in pending)
                sha = base64.b32encode(digest).decode()
                entry = {"page_id": page_id, "url": address, "digest": sha}
                yield entry, write_record(page_id, address, payload, first, sha)
                size += len(payload) + 512
                pending = next(stream, None)

        while pending is not None:
            done.append(write_archive(folder, records()))
        cols = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    return staged(source.mapInArrow(each, "path string, records long, bytes long"), "archives")


ROW = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("record_type", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("refers_to", LongType()), StructField("status", IntegerType()), StructField("payload", StringType())])


def read(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives (column path), as ROW says; a revisit's payload is null.

    Size and digest of a response are taken from the payload itself, and a digest
    that differs from the record's field is an error; a revisit has those its record names.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for _, r in read_archive(fs, path):
                    f, kind = r.fields, r.fields["warc-type"]
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(r.http["content-length"])
                    if kind == "response":
                        size = len(r.payload)
                        if payload_digest(r.payload) != digest:
                            raise ValueError(f"record {f['warc-record-id']} in {path} has another digest than its payload")
                    number = lambda name: int(f[name]) if f.get(name) else None  # noqa: B023, E731
                    body = r.payload.decode() if with_payload and kind == "response" else None
                    rows.append((number("warc-page-id"), f["warc-target-uri"], kind, size, digest, number("warc-refers-to-page-id"), 200, body))
                    held += len(r.payload)
                    if held > RANGE_BYTES or len(rows) >= 5_000:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=ROW.names)

    spread = archives.select("path").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(each, ROW)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns: archives are written to the shared folder and read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
