"""Media columns: content-defined chunking of payloads into a deduplicated chunk store.

A payload (text in UTF-8, padded with bytes 255 to a positive multiple of 576) is cut where a rolling gear hash of its
last 32 bytes has zero low bits, so that equal passages give equal chunks. Payloads are identified by their SHA-256, and
joins on chunk digests pick one owner for each chunk. The store has a row (pack) per distinct payload with the ordered
list of its chunk digests and the Zstandard form of the chunks that it owns; a chunk's form depends on its bytes alone.
Reading takes chunks from the payload's own pack and fetches only foreign ones by a join; every chunk and every payload is
verified against its digest. Texts are stored and read in ``ROUNDS`` parts by their hash, so that the shuffle files of one
part are gone before the next.

Defined results: a null text is empty; equal texts share all values; repeated rows and ids are rows of their own; texts are
stored whole; an empty table gives no rows; other columns are left alone. The stored form of a payload is the
concatenation of its stored chunks in order.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm._util import BYTE_HASH, arrow_rows, binary_parts, discard, materialize, read, release

FRAME = 576
#: Least and largest bytes of a chunk, and zero bits of the hash at a cut: most payloads have under 4096 bytes.
LEAST, MOST, CUT_BITS = 1 << 8, 1 << 14, 10
GEAR = (BYTE_HASH >> np.uint64(32)).astype(np.uint32)
STEP = 4 << 20
LEVEL, ROUNDS = 12, 4


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks. The gear hash at a byte is the sum of the tables' values of the last 32 bytes, each
    shifted left by its age; doubling the covered length five times gives it for all bytes."""
    data, found = np.frombuffer(payload, np.uint8), []
    for lo in range(0, len(data), STEP):
        begin = max(0, lo - 31)
        h = GEAR[data[begin : lo + STEP]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        found.append(np.flatnonzero((h[lo - begin :] >> np.uint32(32 - CUT_BITS)) == 0) + lo + 1)
    out, last = [], 0
    for c in np.concatenate(found).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def _payloads(batch, text_col: str):
    data, offs = binary_parts(batch.column(text_col))
    for lo, hi in zip(offs[:-1], offs[1:]):
        yield int(hi - lo), padded(data[lo:hi].tobytes())


def _features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and mean step of the 8-bit samples, and their number."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    v = np.arange(256)
    mean = float(n @ v) / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64) / max(1, len(x) - 1)
    return f"mean={mean:.4f};dev={max(0.0, float(n @ (v * v)) / len(x) - mean * mean) ** 0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f};samples={len(x)}"


def manifests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload, part, digests) of each row: the payload's SHA-256, its part of the store, and the SHA-256
    of its chunks in order."""

    def run(batches):
        for batch in batches:
            sizes, keys, lists = [], [], []
            for n, payload in _payloads(batch, "text"):
                ends = cuts(payload)
                sizes.append(n)
                keys.append(hashlib.sha256(payload).digest())
                lists.append([hashlib.sha256(payload[a:b]).digest() for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), batch.column("part"), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "payload", "part", "digests"])

    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload binary, part long, digests array<binary>")


@dataclass(frozen=True)
class ChunkStore:
    """packs: (payload, chunks array<struct<seq, digest, own, shared>>, own array<struct<digest, shared, data>>, foreign), one table
    for each part of the payloads."""

    packs: tuple[DataFrame, ...]


def store(docs: DataFrame, manifest: DataFrame, *, text_col: str = "text") -> ChunkStore:
    """Write the chunk store of docs into the shared folder."""

    def run(part: int):
        def packed(batches):
            pack = zstandard.ZstdCompressor(level=LEVEL)
            for batch in batches:
                keys, lists, seen = [], [], set()
                for _, payload in _payloads(batch, "text"):
                    key = hashlib.sha256(payload).digest()
                    if key in seen:
                        continue
                    seen.add(key)
                    ends = cuts(payload)
                    keys.append(key)
                    lists.append([pack.compress(payload[a:b]) for a, b in zip([0, *ends], ends)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["payload", "blobs"])

        text = docs.select(docs[text_col].alias("text")).where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ROUNDS)) == part)
        return text.mapInArrow(packed, "payload binary, blobs array<binary>").groupBy("payload").agg(F.first("blobs").alias("blobs"))

    refs = manifest.select("payload", "part", "digests").groupBy("payload").agg(F.first("digests").alias("digests"), F.first("part").alias("part"))
    refs = materialize(refs.select("payload", "part", F.posexplode("digests").alias("seq", "digest")), "refs")
    owner = refs.groupBy("digest").agg(F.min(F.struct("payload", "seq")).alias("owner"), F.count(F.lit(1)).alias("n"))
    owned = refs.join(owner, "digest").select("payload", "part", F.struct("seq", "digest", (F.struct("payload", "seq") == F.col("owner")).alias("own"), (F.col("n") > 1).alias("shared")).alias("c"))
    lists = materialize(owned.groupBy("payload").agg(F.first("part").alias("part"), F.sort_array(F.collect_list("c")).alias("chunks")), "lists")
    discard(refs)
    own = F.transform(F.filter("chunks", lambda c: c.own), lambda c: F.struct(c.digest.alias("digest"), c.shared.alias("shared"), F.col("blobs")[c.seq].alias("data")))
    packs = []
    for part in range(ROUNDS):
        release(docs.sparkSession)
        rows = run(part).join(lists.where(F.col("part") == part), "payload").select("payload", "chunks", own.alias("own"), F.exists("chunks", lambda c: ~c.own).alias("foreign"))
        packs.append(materialize(rows, "packs"))
    discard(lists)
    release(docs.sparkSession)
    return ChunkStore(tuple(packs))


def read_back(stored: ChunkStore, with_payload: bool = False) -> DataFrame:
    """A row per distinct payload, rebuilt from the store: (payload, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature), and the bytes as ``data`` if asked for. A chunk or payload that fails its digest raises ValueError."""
    fields = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", data binary" * with_payload

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                blobs = {c["digest"]: c["data"] for c in [*row["own"], *(row["others"] or [])]}
                parts = {}
                for d, blob in blobs.items():
                    parts[d] = unpack.decompress(blob, max_output_size=MOST)
                    if hashlib.sha256(parts[d]).digest() != d:
                        raise ValueError("a stored chunk is damaged")
                payload, media = (b"".join(x[c["digest"]] for c in row["chunks"]) for x in (parts, blobs))
                digest = hashlib.sha256(payload)
                if digest.digest() != row["payload"]:
                    raise ValueError("a payload can't be rebuilt")
                out.append((row["payload"], len(payload), digest.hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), _features(payload), *[payload] * with_payload))
            if out:
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in fields.split(", ")])

    others = "cast(null as array<struct<digest: binary, data: binary>>)"
    shared = materialize(functools.reduce(DataFrame.unionByName, (p.select(F.explode(F.filter("own", lambda c: c.shared)).alias("c")).select("c.digest", "c.data") for p in stored.packs)), "shared")
    found = []
    for packs in stored.packs:
        whole = packs.where(~F.col("foreign")).select("payload", "chunks", "own", F.expr(others).alias("others"))
        needing = packs.where("foreign")
        refs = needing.select("payload", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: ~c.own), lambda c: c.digest))).alias("digest"))
        got = refs.join(shared, "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "data")).alias("others"))
        joined = needing.join(got, "payload").select("payload", "chunks", "own", "others")
        found.append(whole.unionByName(joined).mapInArrow(run, fields))
        if not with_payload:  # digests and features are narrow; payloads stay where they are
            found[-1] = materialize(found[-1], "read")
            release(packs.sparkSession)
    if not with_payload:
        discard(shared)
    return functools.reduce(DataFrame.unionByName, found)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 500)
    docs = read(spark, sf_dir, "documents")
    manifest = materialize(manifests(docs), "manifest")
    back = read_back(store(docs, manifest))
    return manifest.select("doc_id", "n_bytes", "payload").join(back, "payload").drop("payload")
