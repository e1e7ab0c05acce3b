"""A versioned key-value log as DataFrames: rows of (user_key binary, seq long, kind int, value binary).

A key's newest version is the one with the largest sequence number, and of equal ones the largest kind. Reads drop keys
whose newest version is a deletion. Range deletions are rows whose value is the exclusive end of the range; they hide
older versions of the keys from their own key on. Merges append their values to the base below them.
"""

from __future__ import annotations

import functools
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veltra.errors import CatalogError
from veltra.operators import levels
from veltra.sources.tables import Table
from veltra.sources.wal import Wal

# Fixed values of the log: kinds of a record.
DELETE, SET, MERGE = 1, 2, 3
#: Of our own: a deletion of all keys from user_key up to value.
RANGE_DELETE = 4
MOST_RANGES = 4096
#: Buckets of a batch that is numbered.
BUCKETS = 256

SCHEMA = T.StructType([T.StructField("user_key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.BinaryType())])


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The log as of a sequence number."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def latest(log: DataFrame, keys="user_key", snapshot: int | None = None) -> DataFrame:
    """Each key's newest version, deletions included. An aggregate with partial results, so a hot key costs one row a task."""
    keys = _keys(keys)
    rest = [c for c in log.columns if c not in (*keys, "seq", "kind")]
    best = visible(log, snapshot).groupBy(*keys).agg(F.max(F.struct("seq", "kind", *rest)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in ("seq", "kind", *rest)])


def live(log: DataFrame, keys="user_key", snapshot: int | None = None) -> DataFrame:
    """latest() without deleted keys."""
    return latest(log, keys, snapshot).where(F.col("kind") != DELETE)


def merged(log: DataFrame, keys="user_key", snapshot: int | None = None, combine=None) -> DataFrame:
    """(keys, value): the newest SET with the MERGE values above it, in sequence order. combine: a Column function of an
    array of values; by default they are joined together. Versions below a key's newest SET or DELETE don't count."""
    keys = _keys(keys)
    rows = visible(log, snapshot)
    # The newest base by an aggregate with partial results: of a hot key's versions only the merges above it meet.
    base = rows.where(F.col("kind") != MERGE).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct("seq", "kind")).alias("_base"))
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    rows = rows.join(base, same, "left").where(F.col("_base").isNull() | (F.struct("seq", "kind") >= F.col("_base"))).where(F.col("kind") != DELETE)
    values = F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind", "value"))), lambda x: x.value)
    out = rows.groupBy(*keys).agg(values.alias("_values"))
    combine = combine or (lambda v: F.aggregate(v, F.lit(b""), lambda a, x: F.concat(a, x)))
    return out.select(*keys, combine(F.col("_values")).alias("value"))


def without_ranges(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The log without range deletions and without the versions that they hide. At most ``MOST_RANGES`` ranges are sent to the
    executors at a time; more go one part after the other. None of these steps moves the log's rows."""
    rows = visible(log, snapshot)
    ranges = rows.where(F.col("kind") == RANGE_DELETE).select(F.col("user_key").alias("_from"), F.col("value").alias("_to"), F.col("seq").alias("_seq"))
    points = rows.where(F.col("kind") != RANGE_DELETE)
    hidden = (F.col("user_key") >= F.col("_from")) & (F.col("user_key") < F.col("_to")) & (F.col("seq") < F.col("_seq"))
    parts = -(-ranges.count() // MOST_RANGES)
    for part in range(parts):
        some = ranges.where(F.pmod(F.xxhash64("_from", "_to", "_seq"), F.lit(2 * parts)).isin(2 * part, 2 * part + 1)) if parts > 1 else ranges
        points = points.join(F.broadcast(some), hidden, "left_anti")
    return points


def scan(log: DataFrame, keys="user_key", snapshot: int | None = None, descending: bool = False) -> DataFrame:
    """First / Next (or Last / Prev): live keys in order."""
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in _keys(keys)]
    return live(log, keys, snapshot).orderBy(*order)


def versions(log: DataFrame, keys="user_key") -> DataFrame:
    """All versions in the order of a full scan: key ascending, then newest first."""
    return log.orderBy(*[F.col(k).asc() for k in _keys(keys)], F.col("seq").desc(), F.col("kind").desc())


def seek_gte(log: DataFrame, key, keys: str = "user_key", snapshot: int | None = None) -> DataFrame:
    """The first live key at or after key. The filter reaches the scan, where row-group statistics skip data."""
    return live(log.where(F.col(keys) >= F.lit(key)), keys, snapshot).orderBy(F.col(keys)).limit(1)


def seek_lte(log: DataFrame, key, keys: str = "user_key", snapshot: int | None = None) -> DataFrame:
    """The last live key at or before key."""
    return live(log.where(F.col(keys) <= F.lit(key)), keys, snapshot).orderBy(F.col(keys).desc()).limit(1)


def seek_prefix_gte(log: DataFrame, prefix, key, keys: str = "user_key", snapshot: int | None = None) -> DataFrame:
    """seek_gte() among the keys with a prefix: empty if none has it."""
    return seek_gte(log.where(F.startswith(F.col(keys), F.lit(prefix))), key, keys, snapshot)


def compacted(log: DataFrame, keys="user_key", bottom: bool = True) -> DataFrame:
    """One version per key; deletions are kept unless this is the bottom level, below which nothing can come back."""
    return live(log, keys) if bottom else latest(log, keys)


def out_of_order(log: DataFrame, partition: Column | str, position: str, strict: bool = True, key: str = "user_key") -> DataFrame:
    """Rows of a sorted file that break its order (key ascending, seq then kind descending). strict: equal trailers count too."""
    w = Window.partitionBy(partition).orderBy(position)
    before = F.lag(F.struct(key, "seq", "kind")).over(w)
    same = F.col("_b")[key] == F.col(key)
    trailer, last = F.struct("seq", "kind"), F.struct(F.col("_b.seq"), F.col("_b.kind"))
    bad = (F.col("_b")[key] > F.col(key)) | (same & (trailer >= last if strict else trailer > last))
    return log.withColumn("_b", before).where(F.col("_b").isNotNull() & bad).drop("_b")


def numbered(rows: DataFrame, order: str, base: int) -> DataFrame:
    """rows of one batch with consecutive sequence numbers from base on, in the order of a column. Columns of numbers or times
    are cut into buckets at their quantiles, whose counts give each bucket its first number; others are numbered in one task."""
    kind = rows.schema[order].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return rows.withColumn("seq", F.lit(base) + F.row_number().over(Window.orderBy(order)) - 1)
    cuts = rows.agg(F.percentile_approx(order, [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).collect()[0][0] or []
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in sorted(set(cuts))]), lambda c: c < F.col(order))), F.lit(-1)) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(bucket))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # over BUCKETS rows
    first = rows.groupBy(F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.coalesce(before, F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return rows.withColumn("_nth", nth).join(F.broadcast(first), F.col("_bucket") == F.col("_b")).withColumn("seq", F.lit(base) + F.col("_n") + F.col("_nth")).drop("_bucket", "_b", "_n", "_nth")


def key_range(rows: DataFrame, start: str, end: str, inclusive: str, by: list[str] | None = None) -> DataFrame:
    """Union of key ranges: the smallest start, and the largest end, of equal ends an inclusive one."""
    top = F.max(F.struct(F.col(end).alias("e"), F.col(inclusive).alias("i")))
    out = rows.groupBy(*(by or [])).agg(F.min(start).alias("start"), top.alias("_top"))
    return out.select(*(by or []), "start", F.col("_top.e").alias("end"), F.col("_top.i").alias("inclusive"))


def folded(log: DataFrame, reads: list[int]) -> DataFrame:
    """The log in fewer rows that read alike as of each of the sequence numbers reads (ascending). Rows between two of them
    fold into one: a base with the merges above it, or, without a base, the merges alone. A range deletion hides older rows of its own stretch
    here and stays for those of earlier ones; deletions go in the first stretch, below which nothing can come back."""
    stretch = F.size(F.filter(F.array(*[F.lit(r).cast("bigint") for r in reads]), lambda r: r < F.col("seq")))
    rows = log.where(F.col("seq") <= reads[-1]).withColumn("_at", stretch)
    out = []
    for at in range(len(reads)):  # as many as there are open snapshots
        own = rows.where(F.col("_at") == at).drop("_at")
        if at:
            out.append(own.where(F.col("kind") == RANGE_DELETE))
        own = without_ranges(own)
        base = own.where(F.col("kind") != MERGE).groupBy(F.col("user_key").alias("_key")).agg(F.max(F.struct("seq", "kind")).alias("_base"))
        above = own.join(base, F.col("user_key").eqNullSafe(F.col("_key")), "left").where(F.col("_base").isNull() | (F.struct("seq", "kind") >= F.col("_base")))
        state = above.groupBy("user_key").agg(F.max("seq").alias("seq"), F.first("_base.kind", True).alias("_kind"), F.sort_array(F.collect_list(F.when(F.col("kind") != DELETE, F.struct("seq", "kind", "value")))).alias("_v"))
        empty, merges_only = F.size("_v") == 0, F.col("_kind").isNull()
        kind = F.when(empty, DELETE).when(merges_only & F.lit(at > 0), MERGE).otherwise(SET)
        value = F.when(~empty, F.aggregate(F.transform("_v", lambda x: x.value), F.lit(b""), lambda a, x: F.concat(a, x)))
        state = state.select("user_key", "seq", kind.cast("int").alias("kind"), value.alias("value"))
        out.append(state if at else state.where(F.col("kind") != DELETE))
    return functools.reduce(DataFrame.unionByName, out)


class Batch:
    """Writes that are applied together with consecutive sequence numbers."""

    def __init__(self):
        self.rows: list[tuple[bytes, int, bytes | None]] = []

    def set(self, key: bytes, value: bytes) -> Batch:
        self.rows.append((key, SET, value))
        return self

    def delete(self, key: bytes) -> Batch:
        self.rows.append((key, DELETE, None))
        return self

    def merge(self, key: bytes, value: bytes) -> Batch:
        self.rows.append((key, MERGE, value))
        return self

    def delete_range(self, start: bytes, end: bytes) -> Batch:
        self.rows.append((start, RANGE_DELETE, end))
        return self

    def __len__(self) -> int:
        return len(self.rows)


def _encoded(row) -> bytes:
    """A row of a log: sequence number, kind, length of the key (and 1 if there is a value), key, value."""
    key, seq, kind, value = row
    return struct.pack("<qiI?", seq, kind, len(key), value is not None) + bytes(key) + bytes(value or b"")


def _decoded(record: bytes) -> tuple:
    seq, kind, size, some = struct.unpack_from("<qiI?", record)
    at = struct.calcsize("<qiI?")
    return bytearray(record[at : at + size]), seq, kind, bytearray(record[at + size :]) if some else None


class KVStore:
    """A key-value store on a versioned table. One commit is one manifest, so a batch is seen whole or not at all."""

    def __init__(self, spark: SparkSession, root: str, name: str = "kv", wal: Wal | None = None):
        """wal: a log that a batch is written to before it becomes visible; what a crash left there is applied first."""
        # Bloom filters on the key let a point read skip row groups.
        self.spark, self.table = spark, Table(spark, root, name, {"parquet.bloom.filter.enabled#user_key": "true", "compression": "zstd"})
        if not self.table.exists():
            self.table.create(SCHEMA)
        self.wal = wal
        if wal is not None:
            self.replay()

    def replay(self) -> None:
        """Apply the logs above the store's sequence number, in order, then drop those that aren't needed any more."""
        for number in [n for n in self.wal.list() if n > self.visible_seq]:
            self.table.append(self.spark.createDataFrame([_decoded(r) for r in self.wal.records(number)], SCHEMA).coalesce(1), seq=number)
        self.wal.obsolete(self.visible_seq + 1)

    @property
    def visible_seq(self) -> int:
        return self.table.manifest().get("seq", 0)

    def apply(self, batch: Batch) -> int:
        """Commit a batch; returns its last sequence number."""
        if not len(batch):
            return self.visible_seq
        base = self.visible_seq + 1
        rows = [(bytearray(k), base + i, kind, None if v is None else bytearray(v)) for i, (k, kind, v) in enumerate(batch.rows)]
        last = base + len(rows) - 1
        if self.wal is not None:
            self.wal.create(last, [_encoded(r) for r in rows])
        self.table.append(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), seq=last)
        if self.wal is not None:
            self.wal.obsolete(last + 1)
        return last

    def append(self, rows: DataFrame) -> int:
        """Commit rows that carry their own sequence numbers, such as a stream's; those seen already are left out."""
        seen = self.visible_seq
        rows = rows.where(F.col("seq") > seen).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields])
        top = rows.agg(F.max("seq")).collect()[0][0]
        if top is None:
            return seen
        self.table.append(rows, seq=top)
        return top

    def set(self, key: bytes, value: bytes) -> int:
        return self.apply(Batch().set(key, value))

    def delete(self, key: bytes) -> int:
        return self.apply(Batch().delete(key))

    def log(self, snapshot: int | None = None) -> DataFrame:
        return without_ranges(self.table.read(), snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        rows = merged(without_ranges(self.table.read().where((F.col("user_key") == F.lit(key)) | (F.col("kind") == RANGE_DELETE)), snapshot)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def items(self, snapshot: int | None = None, descending: bool = False) -> DataFrame:
        out = merged(self.log(snapshot))
        return out.orderBy(F.col("user_key").desc() if descending else F.col("user_key"))

    def seek_gte(self, key: bytes, snapshot: int | None = None) -> DataFrame:
        return seek_gte(self.log(snapshot), key)

    def seek_lte(self, key: bytes, snapshot: int | None = None) -> DataFrame:
        return seek_lte(self.log(snapshot), key)

    def snapshot(self) -> int:
        """The visible sequence number, which stays readable through compactions until release()."""
        seq = self.visible_seq
        self.table.note(snapshots=sorted([*self.table.manifest().get("snapshots", []), seq]))
        return seq

    def release(self, seq: int) -> None:
        held = list(self.table.manifest().get("snapshots", []))
        held.remove(seq)
        self.table.note(snapshots=held)

    def compact(self) -> None:
        """Rewrite the log, sorted, so that files cover disjoint key ranges: of each key one row per open snapshot and one for
        the newest state, with the largest sequence number that went into it."""
        m = self.table.manifest()
        out = folded(self.table.read(), sorted({*m.get("snapshots", []), m.get("seq", 0)}))
        self.table.replace(out.repartitionByRange("user_key").sortWithinPartitions("user_key", F.col("seq").desc()), seq=m.get("seq", 0), snapshots=m.get("snapshots", []))

    def compact_if_due(self, most_bytes: int = levels.BASE_BYTES) -> levels.Pick | None:
        """compact() if the picker names a level: folders written since the last compaction are level 0, the rest is the last level."""
        m = self.table.manifest()
        fresh = len(m["folders"]) - bool(m.get("compacted"))
        due = levels.pick([0] * levels.LEVELS, fresh, most_bytes)
        if due is not None:
            self.compact()
            self.table.note(compacted=True)
        return due

    def close(self) -> None:
        if self.table is None:
            raise CatalogError("the store is closed")
        self.table = None
