"""Quality classifier: random-indexing word vectors and a small calibrated network.

Each hashed word has a fixed sparse index vector; its word vector is the sum of the index vectors
of its neighbours over the whole corpus (one pass over all documents, added up as a table of
fixed size).  A document is pooled to means and deviations of its words' vectors, whole text.
A two-layer network in numpy, fitted on a bounded sample of labelled rows, turns that into a
probability; its temperature is calibrated on a part of the sample that it was not fitted on, and
its offset corrects the sample's class balance.

Defined results: a null or empty text is pooled to zeros and scored like any other; with labels
of one class or none the score is that class's share (a half without any); very long texts are
pooled whole; repeated rows are rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import fold, labelled_sample, read_table, slices, sum_vectors

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Word cells, vector size, neighbours on either side, characters handled at once.
CELLS, SIZE, REACH, CHARS = 1 << 14, 32, 2, 1_000_000
CACHE = 200_000
#: Means, deviations; how alike neighbours are, lengths of the two mean vectors, distinct and top share, size, empty.
POOLED = 4 * SIZE + 7


class Words:
    """Cells of words (case and marks kept), remembering those met."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def cells(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.ids) > CACHE:
            self.ids = {}
        ids, out = self.ids, []
        for t in texts:
            words = TOKEN.findall(t)
            for w in set(words).difference(ids):
                ids[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % CELLS
            out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        return out


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two non-zero numbers of each cell's index vector; the last cell is none."""
    rng = np.random.default_rng(seed)
    place = rng.integers(0, SIZE, (CELLS + 1, 2))
    sign = rng.choice([-1.0, 1.0], (CELLS + 1, 2))
    sign[CELLS] = 0
    return place, sign


def word_vectors(docs: DataFrame) -> np.ndarray:
    """[CELLS, 2 * SIZE]: context vectors from all of ``docs``, then the words' own index vectors."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, (place, sign) = Words(), index_vectors()
        total = np.zeros(CELLS * SIZE)
        gap = np.full(REACH, CELLS)
        for batch in batches:
            for texts in slices(batch.column(0), CHARS):
                ids = np.concatenate([x for c in words.cells(texts) for x in (c, gap)])
                for step in range(1, REACH + 1):
                    for mid, near in ((ids[step:], ids[:-step]), (ids[:-step], ids[step:])):
                        real = mid < CELLS
                        base, near = mid[real] * SIZE, near[real]
                        for k in range(2):
                            total += np.bincount(base + place[near, k], sign[near, k], CELLS * SIZE)
        return total

    context = sum_vectors(docs.select(F.col("text").cast("string").alias("text")), tally, CELLS * SIZE).reshape(CELLS, SIZE)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors()
    own = np.zeros((CELLS, SIZE))
    for k in range(2):
        own[np.arange(CELLS), place[:CELLS, k]] += sign[:CELLS, k] / 2
    return np.concatenate((context, own), 1).astype(np.float32)


def pool(cells: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Means and deviations of the word vectors of each document, its size and whether it is empty."""
    out = np.zeros((len(cells), POOLED), np.float32)
    for k, ids in enumerate(cells):
        if not len(ids):
            out[k, -1] = 1
            continue
        total, square = np.zeros(2 * SIZE), np.zeros(2 * SIZE)
        for a in range(0, len(ids), 100_000):
            v = vectors[ids[a : a + 100_000]]
            total += v.sum(0)
            square += np.einsum("ij,ij->j", v, v)
        # A repeated word comes back at once, or after a mark.
        alike = max(np.count_nonzero(ids[1:] == ids[:-1]), np.count_nonzero(ids[2:] == ids[:-2])) / len(ids)
        mean = total / len(ids)
        out[k, : 2 * SIZE] = mean
        out[k, 2 * SIZE : 4 * SIZE] = np.sqrt(np.maximum(square / len(ids) - mean**2, 0))
        often = np.bincount(ids)
        out[k, 4 * SIZE : 4 * SIZE + 5] = alike, np.linalg.norm(mean[:SIZE]), np.linalg.norm(mean[SIZE:]), np.count_nonzero(often) / len(ids), often.max() / len(ids)
        out[k, -2] = np.log1p(len(ids)) / 8
    return out


class Network:
    """Standardised inputs, a tanh layer, a logit; score = sigmoid(logit / temperature + offset)."""

    def __init__(self, prior: float):
        self.prior, self.params = prior, None
        self.temperature, self.offset = 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.offset, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, decay: float = 3e-3, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        train = order[len(x) // 5 :]
        if len(np.unique(y[train])) < 2:
            return self
        self.mean, self.sd = x[train].mean(0), x[train].std(0) + 1e-3
        p = [rng.normal(0, 0.3 / np.sqrt(x.shape[1]), (x.shape[1], hidden)) * 2, np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(())]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        share = y[train].mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        z_all = np.clip((x - self.mean) / self.sd, -8, 8)
        for t in range(1, steps + 1):
            k = train[rng.integers(0, len(train), min(len(train), 256))]
            z, yy, ww = z_all[k], y[k], weight[k]
            h = np.tanh(z @ p[0] + p[1])
            d = ww * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yy) / len(k)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum()]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.params = p
        # Training weighed both classes alike: the offset puts the corpus's balance back.
        self.offset = float(np.log(max(self.prior, 1e-6) / max(1 - self.prior, 1e-6)))
        if len(np.unique(y[held])) == 2:
            logit, balance = self.logit(x[held]), np.where(y[held] == 1, 0.5 / y[held].mean(), 0.5 / (1 - y[held].mean()))
            loss = lambda t: float((balance * np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logit / t)).sum())
            self.temperature = min(np.geomspace(0.5, 5, 24), key=loss)
        return self


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", per_class: int = 3000) -> Network:
    """A network fitted on at most ``per_class`` labelled documents of each class."""
    sample, sizes = labelled_sample(docs, labels, label, per_class)
    total = sum(sizes.values())
    net = Network(sizes.get(1, 0) / total if total else 0.5)
    if len(sizes) < 2:
        return net

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = np.concatenate([pool(words.cells(texts), vectors.value) for texts in slices(batch.column(0), CHARS)] or [np.zeros((0, POOLED), np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "y"])

    rows = sorted((bytes(r[0]), r[1]) for r in sample.mapInArrow(pooled, "x binary, y int").collect())  # the sample is bounded
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], dtype=float)
    return net.fit(x, np.array([r[1] for r in rows], dtype=float))


def score_quality(docs: DataFrame, net: Network, vectors) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            scores = [shared.value.score(pool(words.cells(texts), vectors.value)) for texts in slices(batch.column(1), CHARS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    net = train(docs, labels.where(~fold("doc_id", 5, 0)), vectors)
    scored = score_quality(docs, net, vectors)
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
