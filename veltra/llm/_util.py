"""Shared helpers of the training-data operators: scratch tables, text batches, word hashing, components."""

from __future__ import annotations

import ctypes.util
import gc
import re
import time
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import veltra

# Workers get the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(veltra)

#: Bytes of text that numpy works on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 2 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/veltra"
    return f"{base.rstrip('/')}/veltra-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables, once all that is made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that earlier plans are gone, so that it removes their shuffle files now rather than later, and
    give the driver's free memory back to the system: a session of many plans would else only grow."""
    for _ in range(2):  # what the first round frees holds what the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    trim()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> bool:
    """The JVM's own command for giving back free native memory (System.trim_native_heap); False where it has none."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName
    values, names = (gateway.new_array(c, 0) for c in (jvm.java.lang.Object, jvm.java.lang.String))
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, c in enumerate((kind("javax.management.ObjectName"), kind("java.lang.String"), values.getClass(), names.getClass())):
        kinds[i] = c
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        kind("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def trim() -> None:
    """Give memory that a fit on the driver has freed back to the system; without glibc there is nothing to do."""
    gc.collect()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
        ctypes.CDLL(libc).malloc_trim(0)


#: Bytes of a batch that goes to Python, or one row that is longer.
BATCH_BYTES = 32 << 20


def arrow_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows per Arrow batch than Spark's default, as texts are long. The bound on bytes is the same for all operators, so
    it holds whichever of them set the rows last before a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8).copy()
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    flat = flat[offs[0] : offs[-1]]
    return flat, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [lo, hi) of at most limit bytes, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


GOLDEN = 0x9E3779B97F4A7C15
BYTE_HASH = mix64((np.arange(1, 257, dtype=np.uint64)) * np.uint64(GOLDEN))
_folded = np.arange(256)
_folded[65:91] += 32
BYTE_HASH_LOWER = BYTE_HASH[_folded]
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
SPACE = _space
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 1024), 0xD6E8FEB86659FD93, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _POWERS = out
    return _POWERS


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in concatenated texts, and each text's n + 1 word offsets."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = word[full]
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint and non-empty spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = stops - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    inside = np.arange(int(length.sum())) - np.repeat(at, length)
    where = inside + np.repeat(starts, length)
    values = table[data[where]] * powers(int(length.max()))[inside]
    return mix64(np.add.reduceat(values, at) + length.astype(np.uint64) * np.uint64(GOLDEN))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; with fewer words the whole run is one; without words there are none. Polynomials of 1,
    2, 4, ... words are put together as k's bits say."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    part, width, power, out, done = words, 1, 0x9FB21C651E98DF25, None, 0
    while True:
        if k & 1:
            size = n - done - width + 1
            out = part if out is None else out[:size] * np.uint64(power) + part[done : done + size]
            done += width
        k >>= 1
        if not k:
            return mix64(out)
        part = part[:-width] * np.uint64(power) + part[width:]
        power, width = power * power % (1 << 64), 2 * width


def hash_unit(*columns: Column | str) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def crc_mod(id_column: str, m: int) -> Column:
    """crc32 of the id's decimal text modulo m."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(m))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id reachable. Each round maps every node to its
    smallest neighbour and contracts the edges, so the number of rounds is logarithmic; nothing goes to the driver
    but whether edges are left."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    result = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "step")
        old = [step, edges]
        if result is None:
            result = step.select(F.col("a").alias("id"), F.col("m").alias("component"))
        else:
            old.append(result)
            result = result.join(step.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
        result = materialize(result, "labels")
        edges = edges.join(step, "a").select(F.col("m").alias("x"), "b").join(step.select(F.col("a").alias("b"), F.col("m").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(edges, "edges")
        discard(*old)
    return result if result is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Classes of bytes: 0 white space, 1 letters, digits and all of other scripts, 2 the rest.
BYTE_CLASS = np.full(256, 2, np.uint8)
BYTE_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
BYTE_CLASS[SPACE] = 0


def class_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the maximal runs of one class (white space aside), and each text's n + 1 run offsets."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    kind = BYTE_CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offs[:-1][offs[1:] > offs[:-1]]] = True
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(data))
    keep = kind[starts] > 0
    starts, stops = starts[keep], stops[keep]
    return starts, stops, kind[starts], np.searchsorted(starts, offs)


#: Bytes of text of either label that a classifier is fitted on at most.
TRAIN_BYTES = 8 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, str | None, int]]:
    """At most bound labelled documents of either label and TRAIN_BYTES of whole texts, by a hash of their ids: (text, label,
    lang, rows of that label that there are per row taken times 1000). Labels that are null or have no document are left
    out; of an id's labels the largest counts, and its smallest text."""
    known = labels.where(keep & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    known = known.withColumn("_label", (F.col("_label") > 0).cast("int"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = []
    for value in sorted(counts):
        first = F.xxhash64(F.lit(5), id_col)
        ids = known.where(F.col("_label") == value).orderBy(first, id_col).limit(bound).select(id_col)
        sizes = docs.select(id_col, F.octet_length(text).alias("_n")).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.max("_n").alias("_n")).orderBy(first, id_col).collect()
        chosen, total = [], 0
        for r in sizes:
            if total + r["_n"] <= TRAIN_BYTES:
                chosen.append((r[0],))
                total += r["_n"]
        if not chosen:
            continue
        picked = docs.sparkSession.createDataFrame(chosen, ids.schema)
        rows = docs.select(id_col, text.alias("_text"), lang.alias("_lang")).join(F.broadcast(picked), id_col)
        rows = rows.groupBy(id_col).agg(F.min(F.struct("_text", "_lang")).alias("t")).select(id_col, "t.*").toArrow().sort_by(id_col)
        share = int(1000 * max(1.0, counts[value] / len(chosen)))
        out += [(t, value, g, share) for t, g in zip(rows["_text"].to_pylist(), rows["_lang"].to_pylist())]
    return out
