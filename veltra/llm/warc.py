"""WARC archives as seekable Zstandard bundles.

Records are written one after another into independent Zstandard frames of about ``frame_bytes``; a bundle is a run of
frames and ends with a skippable frame that holds the seek table (compressed and plain size of each frame). Every bundle
carries an index from record to (frame, offset within the frame, length), so that a record is read by decompressing its
frame alone. Bundles are rows of a Parquet table in the shared folder, as executors have no other common file system;
``export`` yields the bytes of plain .warc.zst files. Equal payloads are stored once: the smallest page_id has the
response record, the others revisit it.

Defined results: a null html is the empty payload; a null url is an empty target; null ids come last and are only
responses where all ids of a payload are null; rows that repeat the smallest id of a payload are all responses; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm._util import arrow_rows, materialize, read

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
DATE = "2020-01-01T00:00:00Z"
BUNDLE_SCHEMA = "bundle binary, entries array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def warc_record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response record, or a revisit record (headers of the response only) where refers_to is another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    size = int(warc["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.table, self.open, self.size, self.entries, self.bytes = [], [], [], 0, [], 0

    def add(self, page_id, raw: bytes) -> None:
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.cut()
        self.entries.append((record_id(page_id), page_id, len(self.frames), self.size, len(raw)))
        self.open.append(raw)
        self.size += len(raw)

    def cut(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.size))
            self.bytes += len(frame)
            self.open, self.size = [], 0

    def close(self) -> bytes:
        self.cut()
        table = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, bundle: bytes):
        n, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEK_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        start = len(bundle) - 9 - n * width
        if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE_MAGIC, n * width + 9):
            raise ValueError("the seek table is damaged")
        self.bundle, self.at, where = bundle, [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", bundle, start + i * width)
            self.at.append((where, packed, plain))
            where += packed
        self.unpack, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            where, packed, plain = self.at[frame]
            self.last = frame, self.unpack.decompress(self.bundle[where : where + packed], max_output_size=plain)
        return self.last[1][offset : offset + length]


def write_bundles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """A table of bundles (bundle, entries) in the shared folder with a record for every row of pages."""
    arrow_rows(pages.sparkSession, 500)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.sha1(html.cast("binary")).alias("sha1"), F.sha2(html.cast("binary"), 256).alias("key"))
    # Owners on narrow columns; then the join is by page, so that a payload of very many pages doesn't meet in one task.
    narrow = rows.select("key", "page_id")
    first = narrow.join(narrow.groupBy("key").agg(F.min("page_id").alias("first")), "key").distinct().toDF("key", "_page", "first")
    rows = rows.join(first, (rows["key"] == first["key"]) & rows["page_id"].eqNullSafe(first["_page"]))
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha1", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches):
        def closed(w):
            bundle = w.close()
            entries = [dict(zip(("record_id", "page_id", "frame", "offset", "length"), e)) for e in w.entries]
            return pa.RecordBatch.from_pylist([{"bundle": bundle, "entries": entries}], schema)

        entry = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        schema = pa.schema([("bundle", pa.binary()), ("entries", pa.list_(entry))])
        w = BundleWriter(frame_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                w.add(r["page_id"], warc_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["size"], digest, r["refers_to"]))
                if w.bytes >= bundle_bytes:
                    yield closed(w)
                    w = BundleWriter(frame_bytes)
        if w.entries:
            yield closed(w)

    return materialize(rows.mapInArrow(run, BUNDLE_SCHEMA), "bundles")


def read_records(bundles: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) of every record, each read through its
    bundle's seek table and index; html is null for revisits. A response whose payload doesn't have its digest raises ValueError."""
    arrow_rows(bundles.sparkSession, 4)  # a row is a whole bundle

    def run(batches):
        names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))))
        for batch in batches:
            for row in batch.to_pylist():
                reader, out, size = BundleReader(row["bundle"]), [], 0
                for e in row["entries"]:
                    warc, http, payload = parse_record(reader.record(e["frame"], e["offset"], e["length"]))
                    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                    if warc["WARC-Record-ID"] != e["record_id"] or kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{e['record_id']} is damaged")
                    to = warc.get("WARC-Refers-To")
                    out.append((e["page_id"], warc["WARC-Target-URI"], payload.decode() if kind == "response" else None, int(http["Content-Length"]), digest, kind, int(to[len("<urn:x-page:") : -1]) if to else None))
                    size += len(payload)
                    if size > BUNDLE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    return bundles.mapInArrow(run, "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def find_records(bundles: DataFrame, ids: list[int]) -> DataFrame:
    """read_records() of these page_ids: only frames that hold them are decompressed."""
    wanted = F.filter("entries", lambda e: e.page_id.isin(ids))
    return read_records(bundles.withColumn("entries", wanted).where(F.size("entries") > 0))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_bundles(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 by groups of five bits of the SHA-1's ten-digit parts.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
