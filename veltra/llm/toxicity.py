"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters, digits and other scripts, A-Z folded) are hashed whole and by their first five and four bytes
into an embedding table. Filters of widths 1 to 3 slide over all words of a text, each takes its maximum over the text, and a
logistic layer scores the maxima's tanh. Training follows the maxima's gradients with Adam; scores are scaled on rows left
out of training, and the operator's own decision uses a threshold calibrated for each language there.

Defined results: null and empty texts have the score of a text without words; texts are scored whole; repeated rows and
ids are rows of their own; labels that are null are left out, and without labels of both kinds every score is the smoothed
share of toxic labels; an unknown or null language has the threshold of all; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veltra.llm._util import BYTE_HASH_LOWER, arrow_rows, binary_parts, class_spans, crc_mod, read, release, slices, span_hashes, training_sample

#: Most labelled rows of either label that the classifier is fitted on.
TRAIN_ROWS = 2500
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Steps of 32 rows that training aims at, within so many passes.
STEPS, EPOCHS = 900, (6, 60)
SCORE_BYTES = 1 << 20


#: Bytes of a word's front that are hashed beside the whole word.
FRONTS = (5, 4)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of buckets for each word (whole and fronts), each text followed by three empty words (buckets 0), and offsets."""
    starts, stops, kind, at = class_spans(data, offs)
    word = kind == 1
    at = np.concatenate([[0], np.cumsum(word)])[at]
    starts, stops = starts[word], stops[word]
    ids = np.empty((len(starts), 1 + len(FRONTS)), np.int32)
    for k, n in enumerate((None, *FRONTS)):
        ends = stops if n is None else np.minimum(stops, starts + n)
        ids[:, k] = (span_hashes(data, starts, ends, BYTE_HASH_LOWER) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 + k * BUCKETS
    return np.insert(ids, np.repeat(at[1:], 3), 0, axis=0), at + 3 * np.arange(len(at))


class ToxicityModel:
    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(11)
        self.table = rng.normal(0, 0.1, ((1 + len(FRONTS)) * BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.conv = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.scale, self.shift, self.prior, self.thresholds, self.threshold = 1.0, 0.0, prior, {}, 0.3
        self.fitted = False

    def _embed(self, ids):
        x = self.table[ids[..., 0]]
        for k in range(1, ids.shape[-1]):
            x = x + self.table[ids[..., k]]
        x[ids[..., 0] == 0] = 0
        return x

    def _filtered(self, ids):
        x = self._embed(ids)
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            y = np.broadcast_to(b, (len(x), FILTERS)).copy()
            for j in range(w):
                y[: len(x) - j] += x[j:] @ c[j * DIM : (j + 1) * DIM]
            yield y

    def logits(self, ids, offs) -> np.ndarray:
        """Every text has at least three (empty) words; the last two begin no window, as it would reach into the next text."""
        best = []
        for y in self._filtered(ids):
            y[offs[1:] - 1] = y[offs[1:] - 2] = -np.inf
            best.append(np.maximum.reduceat(y, offs[:-1], axis=0))
        return np.tanh(np.concatenate(best, axis=1)) @ self.out + self.out_bias

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, lang: list[str | None]) -> ToxicityModel:
        self.prior = float((y @ weight + 1) / (weight.sum() + 2)) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return self
        parts = []
        for some in np.array_split(np.arange(len(texts)), max(1, len(texts) // 100)):
            parts.append(tokens(*binary_parts(pa.array([texts[i] for i in some], pa.string()))))
        words = np.concatenate([w for w, _ in parts])
        offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
        del parts
        rng = np.random.default_rng(7)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        params = [*self.conv, *self.bias, self.out]
        m, v, seen, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.zeros(len(self.table), np.float32), 0
        for _ in range(int(np.clip(STEPS * 32 / max(1, len(train)), *EPOCHS))):
            for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
                length = (offs[1:] - offs[:-1])[batch]
                at = np.concatenate([[0], np.cumsum(length)])
                where = np.arange(at[-1]) + np.repeat(offs[batch] - at[:-1], length)
                a = words[where]
                maxima, places = [], []
                for z in self._filtered(a):
                    place = np.array([lo + np.argmax(z[lo : hi - 2], axis=0) for lo, hi in zip(at[:-1], at[1:])])
                    places.append(place)
                    maxima.append(np.take_along_axis(z, place, 0))
                h = np.tanh(np.concatenate(maxima, 1))
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
                d = ((p - y[batch]) / len(batch)).astype(np.float32)
                dh = np.outer(d, self.out) * (1 - h * h)
                grads, ids, gx = [], [], []
                for k, (w, place) in enumerate(zip(WIDTHS, places)):
                    g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    gc = np.zeros_like(self.conv[k])
                    for j in range(w):
                        at_j = np.minimum(place + j, len(a) - 1)
                        own = a[at_j]
                        gc[j * DIM : (j + 1) * DIM] = np.einsum("bfd,bf->df", self._embed(own), g)
                        back = g[..., None] * self.conv[k][j * DIM : (j + 1) * DIM].T[None]
                        live = (own[..., 0] > 0) & (g != 0)
                        for column in range(own.shape[-1]):
                            ids.append(own[live][:, column])
                            gx.append(back[live])
                    grads.append(gc)
                grads += [dh[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [h.T @ d]
                step += 1
                for i, (q, g) in enumerate(zip(params, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    q -= (0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.out_bias -= np.float32(0.01 * np.sign(d.sum()) * min(1, abs(d.sum()) * 10))
                ids, gx = np.concatenate(ids), np.concatenate(gx)
                if len(ids):
                    by = np.argsort(ids, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[by]) > 0]))
                    used, total = ids[by][first], np.add.reduceat(gx[by], first, axis=0)
                    seen[used] += (total * total).mean(1)
                    self.table[used] -= 0.1 * total / np.sqrt(seen[used] + 1e-8)[:, None]
        self.fitted = True
        z = []
        for i in held:  # one text at a time: the driver's memory is small
            part = words[offs[i] : offs[i + 1]]
            z.append(self.logits(part, np.array([0, len(part)]))[0])
        self._calibrate(np.array(z), y[held], weight[held], [lang[i] for i in held])
        return self

    def _calibrate(self, z, y, weight, lang) -> None:
        """Scale and shift of the logits by weighted likelihood; then the threshold of each language with the best F1, the
        middle of the best range, between 0.3 and 0.7; languages with under 5 of either label have that of all."""
        a, b, y, w = 1.0, 0.0, y.astype(float), weight / weight.mean()
        y = np.where(y > 0, 0.995, 0.005)  # keeps separable rows from driving the scale up without end
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = w * (p - y)
            s = w * p * (1 - p) + 1e-6
            hess = np.array([[(s * z * z).mean() + 1e-2, (s * z).mean()], [(s * z).mean(), s.mean() + 1e-3]])
            step = np.linalg.solve(hess, [(g * z).mean() + 1e-2 * (a - 1), g.mean()])
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.scale, self.shift = float(max(a, 0.05)), float(b)
        score = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
        grid = np.linspace(0.3, 0.7, 41)

        def best(rows):
            hit = [(w[rows] * (score[rows] >= t) * (y[rows] > 0.5)).sum() / max(1e-9, 0.5 * ((w[rows] * (score[rows] >= t)).sum() + (w[rows] * (y[rows] > 0.5)).sum())) for t in grid]
            return float(np.median(grid[np.array(hit) >= max(hit) - 1e-12]))

        self.threshold = best(np.arange(len(y)))
        for g in {x for x in lang if x is not None}:
            rows = np.array([i for i, x in enumerate(lang) if x == g])
            if 5 <= (y[rows] > 0.5).sum() <= len(rows) - 5:
                self.thresholds[g] = best(rows)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(offs) - 1, self.prior)
        out = [self.logits(*tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])) for lo, hi in slices(offs, SCORE_BYTES)]
        return 1 / (1 + np.exp(-np.clip(self.scale * np.concatenate(out).astype(float) + self.shift, -30, 30))) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: tuple[int, int] = (4, 2), rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labels of ids whose crc32 modulo held_out[0] is not held_out[1]."""
    sample = training_sample(docs, labels, label, crc_mod("doc_id", held_out[0]) != held_out[1], rows)
    model = ToxicityModel().fit([t for t, *_ in sample], np.array([y for _, y, *_ in sample]), np.array([s / 1000 for *_, s in sample]), [g for *_, g, _ in sample])
    del sample
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with toxic_score and toxic_rejected (its score reaches its language's threshold). Columns of these names are replaced."""
    arrow_rows(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # a table of fixed size
    kept = docs.drop("toxic_score", "toxic_rejected")

    def run(batches):
        own = pickle.loads(shipped.value)
        for batch in batches:
            s = own.scores(*binary_parts(batch.column(text_col)))
            langs = batch.column(lang_col).to_pylist() if lang_col in batch.schema.names else [None] * len(s)
            reject = s >= np.array([own.thresholds.get(g, own.threshold) for g in langs])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(reject, pa.bool_())], names=[*batch.schema.names, "toxic_score", "toxic_rejected"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("toxic_score", "double").add("toxic_rejected", "boolean"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text", "lang"), train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"), "toxic_rejected")
