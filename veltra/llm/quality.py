"""Quality: random-indexing word vectors pooled per document, and a two-layer network trained in numpy.

Each bucket of hashed tokens (runs of letters or of signs) has a sparse ternary index vector derived from its number. A
pass over all documents adds to every token's context vector the index vectors of its neighbours; the sums have a fixed
size. A document is the mean of its tokens' normalised context vectors plus index vectors, and the shares of token
shapes (capitals, signs, digits, repeats of the token before). A network with one hidden layer scores it; the
temperature of its probabilities is set on rows left out of training.

Defined results: null and empty texts have the score of an all-zero vector; texts are pooled whole; repeated rows and ids
are rows of their own; labels that are null are left out, and without labels of both kinds every score is the smoothed
share of good labels; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veltra.llm._util import BYTE_HASH_LOWER, arrow_rows, binary_parts, class_spans, crc_mod, mix64, read, slices, span_hashes, training_sample

#: Most labelled rows of either label that the network is fitted on.
TRAIN_ROWS = 2500
BUCKETS, DIM, NONZERO, REACH, HIDDEN, EPOCHS = 1 << 13, 64, 2, 2, 32, 40
SHAPES = 6
POOL_BYTES, BLOCK = 1 << 20, 512

_at = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(99)).reshape(BUCKETS, NONZERO)
INDEX_DIM, INDEX_SIGN = (_at % np.uint64(DIM)).astype(np.int64), np.where(_at >> np.uint64(63), 1.0, -1.0)


def token_stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shapes (a 0/1 row) of each token, and each text's offsets."""
    starts, stops, kind, at = class_spans(data, offs)
    h = span_hashes(data, starts, stops, BYTE_HASH_LOWER)
    shape = np.zeros((len(starts), SHAPES), np.float32)
    if len(starts):
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        big, small = upper[stops] - upper[starts], lower[stops] - lower[starts]
        shape[:, 0] = (big > 1) & (small == 0)
        shape[:, 1] = (big == 1) & (small > 0)
        shape[:, 2] = kind == 2
        shape[:, 3] = (kind == 2) & (stops - starts > 1)
        shape[:, 4] = digit[stops] > digit[starts]
        shape[1:, 5] = h[1:] == h[:-1]
        first = at[:-1][at[1:] > at[:-1]]
        shape[first, 5] = 0
    return (h % np.uint64(BUCKETS)).astype(np.int64), shape, at


def context_sums(bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index vectors of the tokens within REACH, added up per bucket; texts are apart."""
    out = np.zeros(BUCKETS * DIM)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for d in range(1, REACH + 1):
        if len(bucket) > d:
            near = text[d:] == text[:-d]
            a, b = bucket[d:][near], bucket[:-d][near]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    out += np.bincount(x * DIM + INDEX_DIM[y, k], INDEX_SIGN[y, k], BUCKETS * DIM)
    return out


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all rows of docs. Tasks send sums of fixed size, which stream through a second
    stage block by block; the driver gets BUCKETS x DIM numbers."""
    arrow_rows(docs.sparkSession)

    def gather(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            data, offs = binary_parts(batch.column(0))
            for lo, hi in slices(offs):
                bucket, _, at = token_stream(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                total += context_sums(bucket, at)
        parts = total.astype(np.int64).reshape(-1, BLOCK * DIM)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])

    def add(batches):
        sums = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])

    n = BUCKETS // BLOCK
    rows = docs.select(text_col).mapInArrow(gather, "block int, sums binary").repartition(n, "block").mapInArrow(add, "block int, sums binary").collect()
    out = np.zeros((n, BLOCK * DIM))
    for r in rows:
        out[r["block"]] += np.frombuffer(r["sums"], np.int64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.maximum(norm, 1)
    used = norm[:, 0] > 0
    if used.any():
        out[used] -= out[used].mean(0)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), INDEX_DIM[:, k]), INDEX_SIGN[:, k])
    return out.astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, shares of shapes, and the logarithm of the number of tokens."""
    out = []
    for lo, hi in slices(offs, POOL_BYTES):
        bucket, shape, at = token_stream(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        n = np.diff(at)
        rows = np.zeros((hi - lo, DIM + SHAPES + 1), np.float32)
        full = n > 0
        if full.any():
            rows[full, :DIM] = np.add.reduceat(vectors[bucket], at[:-1][full], axis=0)
            rows[full, DIM:-1] = np.add.reduceat(shape, at[:-1][full], axis=0)
            rows[full, :-1] /= n[full, None]
            rows[:, -1] = np.log1p(n) / 10
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, DIM + SHAPES + 1), np.float32)


class QualityModel:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.prior, self.fitted, self.temperature, self.shift = vectors, 0.5, False, 1.0, 0.0

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> QualityModel:
        self.prior = float((y @ weight + 1) / (weight.sum() + 2)) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return self
        x = np.concatenate([pooled(self.vectors, *binary_parts(pa.array(texts[i : i + 100], pa.string()))) for i in range(0, len(texts), 100)])
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.dev
        rng = np.random.default_rng(3)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.net = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.net], [np.zeros_like(p) for p in self.net], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                h = np.maximum(x[rows] @ self.net[0] + self.net[1], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.net[2] + self.net[3], -30, 30)))
                d = (p - y[rows]) / len(rows)
                dh = np.outer(d, self.net[2]) * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ dh + 1e-4 * self.net[0], dh.sum(0), h.T @ d, d.sum(keepdims=True))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.net[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.fitted = True
        # Sampling by label shifts the odds by a known factor; the temperature is the one with the best likelihood.
        self.shift = float(np.log(max(weight[y > 0].mean(), 1e-9) / max(weight[y == 0].mean(), 1e-9)))
        z, w = self.logits(x[held]), weight[held]

        def loss(t):
            p = np.clip(1 / (1 + np.exp(-np.clip(z / t + self.shift, -30, 30))), 1e-6, 1 - 1e-6)
            return -(w * (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))).mean()

        self.temperature = float(min(np.geomspace(0.5, 5, 40), key=loss)) if len(held) else 1.0
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.net[0] + self.net[1], 0) @ self.net[2] + self.net[3]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(offs) - 1, self.prior)
        z = self.logits((pooled(self.vectors, data, offs) - self.mean) / self.dev)
        return 1 / (1 + np.exp(-np.clip(z / self.temperature + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: tuple[int, int] = (5, 0), rows: int = TRAIN_ROWS) -> QualityModel:
    """Vectors from all of docs, the network from labels of ids whose crc32 modulo held_out[0] is not held_out[1]."""
    sample = training_sample(docs, labels, label, crc_mod("doc_id", held_out[0]) != held_out[1], rows)
    return QualityModel(word_vectors(docs)).fit([t for t, *_ in sample], np.array([y for _, y, *_ in sample]), np.array([s / 1000 for *_, s in sample]))


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """docs with quality_score; a column of that name is replaced."""
    arrow_rows(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # tables of fixed size
    kept = docs.drop("quality_score")

    def run(batches):
        own = pickle.loads(shipped.value)
        for batch in batches:
            s = own.scores(*binary_parts(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("quality_score", "double"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
