"""WARC records in ZIP packages: written once, read by ranges without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, one line per record with its offset and length. The reader takes
the tail of a package, finds the end-of-central-directory record, follows the ZIP64 locator where
there is one, walks the central directory, and skips each member's local header. Records are then
read by offset, one at a time; nothing is unpacked to disk and memory holds one record.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_on_exit, hot_split_join, open_filesystem, shared_path, write_shared

#: bytes of records that a package holds before the next one begins; the writer buffers these
PACKAGE_BYTES = 48 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format.
LOCAL_SIG, CENTRAL_SIG, END_SIG, END64_SIG, LOCATOR_SIG = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF
END_SIZE, LOCATOR_SIZE, MAX_COMMENT = 22, 20, 65_535


class ArchiveError(ValueError):
    """The package is cut short, compressed where it must be stored, or inconsistent."""


# --- ZIP ------------------------------------------------------------------------------------------


def zip_package(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members; with ``zip64`` sizes and offsets are in ZIP64 fields."""
    out, central = bytearray(), bytearray()
    version = 45 if zip64 else 20
    for name, data in members:
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        size = MASK32 if zip64 else n
        extra = struct.pack("<HHQQ", 1, 16, n, n) if zip64 else b""
        out += struct.pack("<4sHHHHHIIIHH", LOCAL_SIG, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if zip64 else b""
        central += struct.pack(
            "<4sHHHHHHIIIHHHHHII", CENTRAL_SIG, version, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, MASK32 if zip64 else at
        ) + raw + extra
    start, n = len(out), len(members)
    out += central
    if zip64:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", END64_SIG, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<4sIQI", LOCATOR_SIG, 0, end, 1)
        out += struct.pack("<4sHHHHIIH", END_SIG, 0, 0, MASK16, MASK16, MASK32, MASK32, 0)
    else:
        out += struct.pack("<4sHHHHIIH", END_SIG, 0, 0, n, n, len(central), start, 0)
    return bytes(out)


@dataclass
class Member:
    name: str
    #: of the member's bytes in the package
    offset: int
    size: int
    crc: int
    stored: bool


class ZipReader:
    """Directory of a package behind ``read_at(offset, length)`` and its size."""

    def __init__(self, read_at, size: int):
        self._read, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}

    def read(self, offset: int, length: int) -> bytes:
        data = self._read(offset, length)
        if len(data) != length:
            raise ArchiveError(f"{length} bytes at {offset} are missing")
        return data

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - END_SIZE - MAX_COMMENT)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END_SIG)
        while at >= 0:  # a comment may hold the signature
            if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at = tail.rfind(END_SIG, 0, at)
        if at < 0:
            raise ArchiveError("no end of central directory")
        _, _, _, _, count, length, start, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
        locator_at = tail_at + at - LOCATOR_SIZE
        if locator_at >= 0 and (locator := self.read(locator_at, LOCATOR_SIZE))[:4] == LOCATOR_SIG:
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64_SIG:
                raise ArchiveError("the ZIP64 locator points at something else")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, found, p = self.read(start, length), [], 0
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL_SIG:
                raise ArchiveError("the central directory is broken")
            method, crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<10xHxxxxIIIHHH", directory, p)
            (at,) = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n_name].decode()
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            packed, size, at = self._zip64(extra, packed, size, at)
            local = self.read(at, 30)
            if local[:4] != LOCAL_SIG:
                raise ArchiveError(f"{name} has no local header")
            skip = sum(struct.unpack_from("<HH", local, 26))
            found.append(Member(name, at + 30 + skip, packed, crc, method == 0))
            p += 46 + n_name + n_extra + n_comment
        return found

    @staticmethod
    def _zip64(extra: bytes, packed: int, size: int, at: int) -> tuple[int, int, int]:
        """Values that don't fit the directory's fields come from the ZIP64 extra field, in order."""
        p = 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                size = next(wide) if size == MASK32 else size
                packed = next(wide) if packed == MASK32 else packed
                at = next(wide) if at == MASK32 else at
            p += 4 + n
        return packed, size, at

    def stored(self, name: str) -> Member:
        if name not in self.members:
            raise ArchiveError(f"no member {name}")
        if not self.members[name].stored:
            raise ArchiveError(f"{name} is compressed; ranges of it can't be read")
        return self.members[name]

    def range(self, name: str, offset: int, length: int) -> bytes:
        m = self.stored(name)
        if offset < 0 or offset + length > m.size:
            raise ArchiveError(f"{offset}+{length} is outside of {name}")
        return self.read(m.offset + offset, length)


# --- WARC -----------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's length as the HTTP head states it, and the payload that is there."""
    head, split, rest = data.partition(b"\r\n\r\n")
    if not split or not head.startswith(b"WARC/"):
        raise ArchiveError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ArchiveError("the record is cut short")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def _page_of(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


# --- Spark ----------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): of equal payloads of at least ``min_bytes`` bytes
    the row with the largest id is the response. Rows that repeat that id are responses too."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    alike = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    alike = write_shared(alike.filter("n > 1"), "payloads")
    total = rows.select("key").count()
    joined = hot_split_join(rows, alike.select("key", "first"), "key", alike.select("key", "n"), total, "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write packages to ``folder`` and return their manifest (path, bytes, records). A task that runs
    again writes packages of new names; only those in the manifest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_filesystem(folder)
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            body = zip_package([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())])
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(body)
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(body)], pa.int64()), pa.array([len(index)], pa.int64())], names=["path", "bytes", "records"])
            data.clear()
            index.clear()
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                digest = digest_of(payload)
                packed = gzip.compress(warc_record(page_id, url, payload, digest, refers_to, revisit), 1, mtime=0)
                facts = {"page_id": page_id, "url": url, "digest": f"sha1:{digest}", "offset": len(data), "length": len(packed), "filename": DATA}
                index.append(f"{_uri(url) or '-'} 20240101000000 {json.dumps(facts)}")
                data += packed
                if len(data) >= PACKAGE_BYTES:
                    yield close()
        if index:
            yield close()

    return write_shared(records.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the packages in ``manifest``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and payload (null for revisits, and for all unless
    ``with_payload``). Lengths and digests of responses are checked against the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    archive = ZipReader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    index = archive.stored(INDEX)
                    rows, held = [], 0
                    for line in archive.range(INDEX, 0, index.size).decode().split("\n"):
                        facts = json.loads(line.split(" ", 2)[2])
                        record = gzip.decompress(archive.range(facts["filename"], facts["offset"], facts["length"]))
                        headers, length, payload = parse_record(record)
                        kind = headers["warc-type"]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
                            raise ArchiveError(f"the payload of {headers['warc-record-id']} isn't what was written")
                        refers_to = _page_of(headers.get("warc-refers-to"))
                        kept = payload if with_payload and kind == "response" else None
                        rows.append((_page_of(headers["warc-record-id"]), facts["url"], length, digest, kind, refers_to, kept))
                        held += len(kept or b"")
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    paths = manifest.select("path").repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return paths.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, with_payload: bool = False, **cols) -> DataFrame:
    """Write all of ``pages`` as packages in the shared folder and read them back.

    Null html counts as an empty payload, a null url stays null, equal rows with the largest id are
    all responses, rows without an id come back without one (as revisits where another row of the
    payload has an id). An empty table makes no package and gives no row; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "archives")
    open_filesystem(folder)  # raises here, not in a task
    manifest = write_archives(plan_records(pages, **cols), folder)
    delete_on_exit(spark, folder)
    return read_archives(spark, manifest, folder, with_payload)


#: five hexadecimal digits of the SHA-1 are four digits of base 32
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, url, payload, h, max(page_id) OVER (PARTITION BY payload) AS first,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS digest
  FROM p
)
SELECT page_id, url, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d
"""
