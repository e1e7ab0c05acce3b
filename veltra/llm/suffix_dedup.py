"""Exact substring deduplication over a Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else in the corpus. Every window of
that length is assigned to the leftmost smallest hash among its runs of ``SEED`` bytes, so equal windows have equal
minimisers at equal places; consecutive windows with one minimiser make a segment. Segments whose minimiser occurs once
are unique; equal segments repeat each other; what is left meets by minimiser in blocks of bounded size. There a suffix
array gives the transform, and intervals are extended backwards breadth first: the intervals of strings one byte longer
each set the common prefix of their right border where it isn't set yet, so common prefixes come up by increasing value,
and the expansion stops at ``length``; borders not set by then have a common prefix of at least ``length`` bytes.

A minimiser with over ``MOST_SEGMENTS`` different segments would make a block of unbounded size. It is split by what its
windows have in common: first by 16 neighbouring window starts and the bytes that these share, whose pieces meet in
blocks again; then, where over ``MOST_SEGMENTS`` pieces differ in the last few bytes only, window by window, where equal
digests of whole windows are equal windows. Text is compared by bytes; segments, pieces and single windows by 128-bit
hashes. Counts per minimiser, segment or window are aggregates that are joined back: none needs a key's rows in one task.

Defined results: a null text is empty; texts shorter than ``length`` stay; overlaps and repeats inside one text count;
a repeated row repeats its text; equal ids may have different texts; an empty table gives no rows; other columns are left
alone. Spans are judged on the input, and may cut characters of several bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm._util import BYTE_HASH, GOLDEN, arrow_rows, binary_parts, discard, materialize, mix64, read, release, slices

SEED, LENGTH = 160, 400
PIECE = 1 << 20
#: Bytes of a block, and segments of one minimiser that are put into one.
BLOCK_BYTES, MOST_SEGMENTS, GRID = 1 << 20, 1024, 16
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes modulo 2**64 of any part of a text by prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.back = _power(inverse, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * _power(base, len(data) + 1)[:-1], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.back[lo])


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each width values; values lose their low 22 bits, which hold the place."""
    n = len(values) - width + 1
    packed = (values & ~np.uint64((1 << 22) - 1)) | np.arange(len(values), dtype=np.uint64)
    pad = -len(packed) % width
    packed = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(packed, axis=1).reshape(-1)
    behind = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 22) - 1)).astype(np.int64)


def segments(data: np.ndarray, offs: np.ndarray, length: int, seed: int):
    """Segments of concatenated texts of under 2**22 bytes: minimiser hash, text, first window, windows, distance of the
    minimiser from the first window, and two hashes of the bytes with that distance."""
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 7
    hashers = [Hasher(data, b) for b in BASES]
    at = np.arange(len(data) - seed + 1)
    grams = hashers[0](at, at + seed)
    place = _leftmost_minima(grams, length - seed + 1)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = text[: len(place)] == text[length - 1 :]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (text[1 : len(place)] != text[: len(place) - 1])
    start = np.flatnonzero(first)
    bounds = np.append(np.flatnonzero(first | ~valid), len(valid))
    windows = bounds[np.searchsorted(bounds, start) + 1] - start
    a = place[start]
    away = (a - start).astype(np.uint64)
    keys = [mix64(f(start, start + windows + length - 1) + away * np.uint64(GOLDEN) + windows.astype(np.uint64)) for f in hashers]
    return [grams[a].view(np.int64), text[start], start - offs[text[start]], windows, a - start, keys[0].view(np.int64), keys[1].view(np.int64)]


def _pieces(data: np.ndarray, offs: np.ndarray, length: int):
    """Texts in slices; a text longer than a slice in parts that overlap by length - 1 bytes: (bytes, offsets, rows, places)."""
    for lo, hi in slices(offs, PIECE):
        if hi - lo == 1 and offs[hi] - offs[lo] > PIECE:
            for p in range(0, int(offs[hi] - offs[lo]), PIECE):
                part = data[offs[lo] + p : min(offs[lo] + p + PIECE + length - 1, offs[hi])]
                yield part, np.array([0, len(part)]), np.array([lo]), p
        else:
            yield data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], np.arange(lo, hi), 0


def suffix_array(x: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of x, no two of which agree on longest symbols."""
    n, size = len(x), int(x.max()) + 1
    k = max(1, int(62 / np.log2(size + 1)))
    padded = np.concatenate([x + 1, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key * (size + 1) + padded[j : j + n]
    while True:
        order = np.argsort(key, kind="quicksort")
        sorted_key = key[order]
        new = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if k >= longest or new.sum() == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


def common_prefixes(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Entry i: the common prefix of suffixes order[i - 1] and order[i] if below length, else -1."""
    n = len(x)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    bwt, step_back = x[order - 1], where[order - 1]
    run = np.concatenate([[0], np.cumsum(bwt[1:] != bwt[:-1])])
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n])
    size = int(x.max()) + 1
    for value in range(length):
        one = run[lo] == run[hi - 1]
        new_lo, new_n = [step_back[lo[one]]], [(hi - lo)[one]]
        if not one.all():
            a, count = lo[~one], (hi - lo)[~one]
            at = np.cumsum(count) - count
            element = np.arange(count.sum()) - np.repeat(at - a, count)
            key = np.repeat(np.arange(len(a)), count) * size + bwt[element]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            new_lo.append(step_back[element[by[first]]])
            new_n.append(np.diff(np.append(first, len(key))))
        lo, count = np.concatenate(new_lo), np.concatenate(new_n)
        hi = lo + count
        keep = lcp[hi] < 0
        if value == 0:
            keep |= hi == n
        lcp[hi[lcp[hi] < 0]] = value
        lo, hi = lo[keep], hi[keep]
        # Of intervals with the same right border only one is kept: those of one length are disjoint.
        if not len(lo):
            break
    return lcp


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its places start a string of length bytes that also starts elsewhere in the parts."""
    size = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(size)
    x = np.empty(ends[-1], np.int64)
    own = np.ones(len(x), bool)
    own[ends - 1] = False
    x[own] = np.frombuffer(b"".join(parts), np.uint8)
    x[own] += len(parts)
    x[~own] = np.arange(len(parts))  # separators differ, so that no match crosses them
    order = suffix_array(x, int(size.max()))
    long = common_prefixes(x, order, length) < 0
    hit = np.zeros(len(x), bool)
    hit[order[long[:-1] | long[1:]]] = True
    return [hit[a : b - length] if b - length > a else np.zeros(0, bool) for a, b in zip(ends - size, ends)]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "id long, th long, lo long, hi long"


def _spans(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["id", "th", "lo", "hi"])


def _expand(length: int):
    """Blocks of whole groups of one key, from batches sorted by key: (key, id, th, p, single, b)."""

    def run(batches):
        block, last, size = [], None, 0

        def settle():
            out = []
            for row, flags in zip(block, repeated([r[4] for r in block], length)):
                if row[3]:
                    out += [(row[0], row[1], row[2] + a, row[2] + b + length - 1) for a, b in zip(*(y.tolist() for y in _intervals(flags)))]
            return _spans(out)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "th", "p", "single", "b")]
            for key, *row in zip(batch.column("key").to_pylist(), *columns):
                if key != last and size >= BLOCK_BYTES:
                    yield settle()
                    block, size = [], 0
                block.append(row)
                size += len(row[4])
                last = key
        if block:
            yield settle()

    return run


def _split(length: int, step: int):
    """Segments to pieces of windows whose distance to the minimiser falls in one cell of a grid of step; their key is
    a hash of the bytes that all windows of the cell share, and s1 and s2 one of their own bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for key, i, t, p, single, away, b in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "th", "p", "single", "away", "b"))):
                n = len(b) - length + 1
                w = 0
                while w < n:
                    d = away - w
                    stop = min(n, w + d % step + 1)
                    core = away - d // step * step  # the window start that is last in the cell
                    shared = b[core : core - step + 1 + length]
                    h = hashlib.blake2b(shared, digest_size=16, salt=(d // step).to_bytes(16, "little", signed=True), key=key.to_bytes(8, "little", signed=True)).digest()
                    piece = b[w : stop + length - 1]
                    own = hashlib.blake2b(piece, digest_size=16, key=d.to_bytes(8, "little", signed=True)).digest()
                    out.append((*_halves(h), i, t, p + w, single, d, *_halves(own), piece))
                    w = stop
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["key", "key2", "id", "th", "p", "single", "away", "s1", "s2", "b"])

    return run


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


PIECES = "key long, key2 long, id long, th long, p long, single boolean, away long, s1 long, s2 long, b binary"


def _windows(length: int):
    """Each window of pieces with its digest: (id, th, p, s1, s2)."""

    def run(batches):
        for batch in batches:
            out = []
            for key, i, t, p, away, b in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "th", "p", "away", "b"))):
                salt = key.to_bytes(8, "little", signed=True)
                out += [(i, t, p + w, *_halves(hashlib.blake2b(b[w : w + length], digest_size=16, key=salt).digest())) for w in range(len(b) - length + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names=["id", "th", "p", "s1", "s2"])

    return run


def _marked(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, s1, s2, id, th, p) with equal, how many have one s1 and s2, kinds, how many different ones a key has, and
    owner, whether the row is the first of its kind; those that are alone with their key go."""
    kinds = materialize(rows.groupBy(*key, "s1", "s2").agg(F.count(F.lit(1)).alias("equal"), F.min(F.struct("id", "th", "p")).alias("owner")), "kinds")
    # Written first, as Spark splits a frequent key of a join only where both sides come straight from a shuffle.
    count = materialize(kinds.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds")), "count")
    out = rows.join(kinds, [*key, "s1", "s2"]).join(count, key).where("equal > 1 or kinds > 1")
    return out.withColumn("owner", F.struct("id", "th", "p") == F.col("owner")).drop("s1", "s2")


def spans(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, th, lo, hi) of the byte ranges that repeat; docs: (id, th, text)."""

    def cut(batches):
        names = ["h", "id", "th", "p", "windows", "away", "s1", "s2"]
        for batch in batches:
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for data, offs, rows, base in _pieces(*binary_parts(batch.column("text")), length):
                h, text, p, windows, away, s1, s2 = segments(data, offs, length, seed)
                row = rows[text]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, ids[row], ths[row], p + base, windows.astype(np.int32), away.astype(np.int32), s1, s2)], names=names)

    found = docs.mapInArrow(cut, "h long, id long, th long, p long, windows int, away int, s1 long, s2 long")
    often = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    release(docs.sparkSession)
    again = materialize(found.join(often, "h", "left_semi"), "again")
    discard(often)
    release(docs.sparkSession)
    hits = materialize(_marked(again, ["h"]), "hits")
    discard(again)
    release(docs.sparkSession)
    whole = hits.where("equal > 1").select("id", "th", F.col("p").alias("lo"), (F.col("p") + F.col("windows") + (length - 1)).alias("hi"))

    wanted = hits.where("kinds > 1 and owner").groupBy("id", "th").agg(F.collect_set(F.struct("h", "p", "windows", "away", "equal", "kinds")).alias("s"))
    wanted = wanted.select("id", "th", *[F.col("s")[c].alias(c) for c in ("h", "p", "windows", "away", "equal", "kinds")])

    def fetch(batches):
        names = ["key", "id", "th", "p", "single", "away", "kinds", "b"]
        for batch in batches:
            data, offs = binary_parts(batch.column("text"))
            raw = data.tobytes()
            ids, ths = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            lists = [batch.column(c).to_pylist() for c in ("h", "p", "windows", "away", "equal", "kinds")]
            for r in range(len(ids)):
                h, p, windows, away, equal, kinds = (x[r] for x in lists)
                at = int(offs[r])
                parts = [raw[at + a : at + a + w + length - 1] for a, w in zip(p, windows)]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([ids[r]] * len(h), pa.int64()), pa.array([ths[r]] * len(h), pa.int64()), pa.array(p, pa.int64()), pa.array([e == 1 for e in equal], pa.bool_()), pa.array(away, pa.int64()), pa.array(kinds, pa.int64()), pa.array(parts, pa.binary())], names=names)

    parts = docs.join(wanted, ["id", "th"]).select("id", "th", "text", "h", "p", "windows", "away", "equal", "kinds")
    parts = materialize(parts.mapInArrow(fetch, "key long, id long, th long, p long, single boolean, away long, kinds long, b binary"), "parts")
    release(docs.sparkSession)

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.select("key", "id", "th", "p", "single", "b").repartition("key").sortWithinPartitions("key").mapInArrow(_expand(length), SPANS)

    out = blocks(parts.where(F.col("kinds") <= MOST_SEGMENTS)).unionByName(whole)
    hot = parts.where(F.col("kinds") > MOST_SEGMENTS)
    if not hot.isEmpty():
        # Equal pieces are one piece that repeats; of the rest, keys with few pieces go to blocks.
        pieces = materialize(hot.mapInArrow(_split(length, GRID), PIECES), "pieces")
        pieces = materialize(_marked(pieces, ["key", "key2"]), "marked")
        out = out.unionByName(pieces.where("equal > 1").select("id", "th", F.col("p").alias("lo"), (F.col("p") + F.octet_length("b")).alias("hi")))
        rest = pieces.where("owner and kinds > 1").withColumn("single", F.col("single") & (F.col("equal") == 1))
        out = out.unionByName(blocks(rest.where(F.col("kinds") <= MOST_SEGMENTS)))
        single = materialize(rest.where(F.col("kinds") > MOST_SEGMENTS).mapInArrow(_windows(length), "id long, th long, p long, s1 long, s2 long"), "windows")
        same = materialize(single.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "same")
        out = out.unionByName(single.join(same, ["s1", "s2"], "left_semi").select("id", "th", F.col("p").alias("lo"), (F.col("p") + length).alias("hi")))
    return materialize(out, "spans")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<lo, hi>>, kept binary) of each row: the byte ranges that go and the rest."""
    arrow_rows(docs.sparkSession, 1000)
    seed = seed or max(1, length * 2 // 5)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("id", F.xxhash64("doc_id")).withColumn("th", F.xxhash64("text"))
    ranges = spans(rows.select("id", "th", "text"), length, seed).groupBy("id", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = rows.join(ranges, ["id", "th"], "left").select("doc_id", "text", "lo", "hi")

    def run(batches):
        pair = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
        for batch in batches:
            data, offs = binary_parts(batch.column("text"))
            removed, lists, kept = [], [], []
            for at, end, lo, hi in zip(offs[:-1], offs[1:], batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                mark = np.zeros(end - at + 1, np.int32)
                np.add.at(mark, np.array(lo or [], np.int64), 1)
                np.add.at(mark, np.array(hi or [], np.int64), -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                lists.append([{"lo": a, "hi": b} for a, b in zip(*(y.tolist() for y in _intervals(gone)))])
                kept.append(data[at:end][~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(lists, pa.list_(pair)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
