"""Toxicity: a convolutional text classifier in numpy, with thresholds by language.

A word is the sum of hashed embeddings of itself and of its beginnings; filters of several
widths slide over the words of the whole text, the highest answer of each filter is kept, and a
logistic unit joins them.  Embeddings, filters and unit are trained together on all labelled rows
but a fifth, dealt over partitions: in each of ``ROUNDS`` every partition trains a copy on all its
rows, and what the copies have moved is averaged by the steps that moved it.  For each language,
told from the text by its function words, a threshold is calibrated on that fifth, counted whole by
score in ``BINS`` steps, and scores are stretched so that it lies at 0.7.

Defined results: a null or empty text is all padding and scored like any other; with labels of
one class or none every score is 0; very long texts are learned and scored whole; repeated rows are rows of their own; an empty table gives no
rows; ``keep_clean`` keeps the columns it is given.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import checkpoint, fold, labelled_rows, read_table, slices, sum_vectors

WORD = re.compile(r"[^\W\d_]+")
#: Embedding cells and size, filter widths, filters of each width, score of every threshold.
CELLS, SIZE, WIDTHS, FILTERS, AT = 1 << 15, 16, (1, 2, 3), 12, 0.7
PARTS = 4  # hashed parts of a word
CHARS, CACHE = 600_000, 150_000
#: Words whose filter answers stand in memory at once: few, so that they stay in the processor's cache.
WINDOW = 4_000
#: Rows of a partition in training, rounds of averaging, least rows seen in all, steps of counted scores.
SHARD, ROUNDS, VISITS, BINS = 4_000, 3, 24_000, 4_096
#: Averages are summed in whole numbers of this part of one, so that they are equal in any order.
PART = 1 << 24
#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit sich auf für von dem den im als auch".split(),
    "en": "the of and to is that it for was with as be by this are at from".split(),
    "es": "el los las del por con para una su se lo y al como más".split(),
    "fr": "le les des et du une est que qui dans pour pas sur avec au".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]
LANGUAGE_OF = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words}


#: What each character of Latin-1 becomes in ``words_of``: itself, or a blank if it is no letter.
LATIN_1 = bytes(k if WORD.fullmatch(chr(k)) else 32 for k in range(256))


def words_of(text: str) -> list[str]:
    """All matches of ``WORD`` in the lower-cased text; texts of Latin-1 take a table in its place."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(LATIN_1).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(low)


#: CRC of the number that stands before each part of a word.
MARKS = tuple(zlib.crc32(str(k).encode()) for k in range(PARTS))


def parts(word: str) -> tuple[int, ...]:
    """Cells of a word: itself and its beginnings of three, four and five letters."""
    b = word.encode("utf-8", "surrogatepass")
    begin = [b[:n] for n in (3, 4, 5)] if len(b) == len(word) else [word[:n].encode("utf-8", "surrogatepass") for n in (3, 4, 5)]
    return tuple(zlib.crc32(x, mark) % CELLS for x, mark in zip((b, *begin), MARKS, strict=True))


def language(words: list[str]) -> str:
    """Language by function words (ties and none: ``other``)."""
    votes = Counter(map(LANGUAGE_OF.get, words))
    votes.pop(None, None)
    best = max(votes.values(), default=0)
    return next((k for k, v in votes.items() if v == best), "other") if best and sum(v == best for v in votes.values()) == 1 else "other"


class Convolution:
    """Embeddings [CELLS, SIZE], filters by width, and a logistic unit over the maxima."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (CELLS, SIZE)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.25, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.out, self.shift = rng.normal(0, 0.2, n).astype(np.float32), np.float32(0)
        self.thresholds: dict[str, float] = {}
        self.fallback = 0.5
        self.ready = False

    def sums_of_filters(self, x: np.ndarray) -> np.ndarray:
        """What each filter adds up at each word of padded word vectors ``x`` (two of padding at the end), without its bias."""
        n = len(x) - max(WIDTHS) + 1
        each = x @ np.concatenate([self.filters[w][k * SIZE : (k + 1) * SIZE] for w in WIDTHS for k in range(w)], 1)
        out, at = np.empty((n, FILTERS * len(WIDTHS)), each.dtype), 0
        for j, w in enumerate(WIDTHS):
            own = out[:, j * FILTERS : (j + 1) * FILTERS]
            own[:] = each[:n, at : at + FILTERS]
            for k in range(1, w):
                own += each[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += w * FILTERS
        return out

    def cut(self, top: np.ndarray) -> np.ndarray:
        """Answers of the filters from their highest sums: the bias and the cut at zero change no order."""
        return np.maximum(top + np.concatenate([self.bias[w] for w in WIDTHS]), 0)

    def raw(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Uncalibrated probabilities of documents that stand in ``x`` one after another, each padded by the widest filter.

        A filter that begins in the padding's end would see the next document, so none does.
        """
        more = max(WIDTHS) - 1
        ends = np.append(starts[1:], len(x)) - more
        z = self.sums_of_filters(np.concatenate((x, np.zeros((more, x.shape[1]), x.dtype))))
        return self.told(self.cut(np.maximum.reduceat(z, np.stack((starts, ends), 1).ravel(), axis=0)[::2]))

    def told(self, top: np.ndarray) -> np.ndarray:
        """Probabilities of the highest answers ``top``."""
        return 1 / (1 + np.exp(-np.clip(top @ self.out + self.shift, -30, 30)))

    def stretch(self, p: float, lang: str) -> float:
        t = self.thresholds.get(lang, self.fallback)
        return float(AT * p / t if p < t else AT + (1 - AT) * (p - t) / max(1e-9, 1 - t))

    def seed_table(self, seen: np.ndarray, bad: np.ndarray, share: float) -> None:
        """Start the first number of each cell at how far its documents (``bad`` of ``seen``) stray from the mean."""
        expect = seen * share
        self.table[:, 0] = np.clip((bad - expect) / np.sqrt(expect + 1), -3, 6) / 6
        for w in WIDTHS:
            self.filters[w][0, : FILTERS // 2] = np.abs(self.filters[w][0, : FILTERS // 2]) + 0.3
        for i in range(len(WIDTHS)):
            self.out[i * FILTERS : i * FILTERS + FILTERS // 2] = np.abs(self.out[i * FILTERS : i * FILTERS + FILTERS // 2])

    def sums(self) -> dict[str, np.ndarray]:
        """Adagrad's sums of squares before any step."""
        return {k: np.full_like(v, 1e-2) for k, v in self._params().items()}

    def train(self, docs: list[np.ndarray], y: np.ndarray, share: float, sums: dict[str, np.ndarray], visits: int, seed: tuple[int, ...], rate: float = 0.08, batch: int = 32) -> tuple[np.ndarray, int]:
        """Adagrad on batches, every row at least once; only the place of each filter's highest answer has a gradient.

        Returns the steps that moved each cell, and all steps.  ``share`` is that of class 1 in all partitions.
        """
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        pad = max(WIDTHS) - 1
        order = np.concatenate([rng.permutation(len(docs)) for _ in range(-(-visits // len(docs)))])[: max(visits, len(docs))]
        touched = np.zeros(CELLS, np.int64)
        for at_row in range(0, len(order), batch):
            chosen = order[at_row : at_row + batch]
            xs, own_cells, keeps, ats, tops, base = [], [], [], [], [], 0
            for i in chosen:
                d = docs[i].astype(np.intp)
                size = len(d) + pad + (len(d) == 0)
                x, keep = np.zeros((size, SIZE), np.float32), np.zeros(size, bool)
                keep[: len(d)] = rng.random(len(d)) > 0.1
                x[: len(d)] = sum(self.table.take(d[:, k], axis=0) for k in range(1, PARTS)) + self.table.take(d[:, 0], axis=0)
                x *= keep[:, None]
                z = self.sums_of_filters(x)
                at = z.argmax(0)
                tops.append(z[at, np.arange(z.shape[1])])
                ats.append(at + base)
                xs.append(x)
                keeps.append(keep)
                own_cells.append(np.concatenate((d, np.zeros((size - len(d), PARTS), np.intp))))
                base += size
            x, keep, own_cells = np.concatenate(xs), np.concatenate(keeps), np.concatenate(own_cells)
            at, top = np.stack(ats), self.cut(np.stack(tops))
            g = weight[chosen] * (self.told(top) - y[chosen])
            gz = g[:, None] * self.out * (top > 0)
            grads = {"out": (g[:, None] * top).sum(0), "shift": g.sum()}
            cells, moves = [], []
            for j, w in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                place = at[:, own, None] + np.arange(w)
                win = x[place].reshape(len(chosen), FILTERS, w * SIZE)
                grads[f"f{w}"] = (win * gz[:, own, None]).sum(0).T
                grads[f"b{w}"] = gz[:, own].sum(0)
                back = (self.filters[w].T * gz[:, own, None]).reshape(len(chosen), FILTERS, w, SIZE)
                ok = keep[place] & (gz[:, own, None] != 0)
                cells.append(own_cells[place[ok]])
                moves.append(back[ok])
            for k, g in grads.items():
                g = g / len(chosen)
                sums[k] += g * g
                value = self._params()[k]
                value -= rate * g / np.sqrt(sums[k])
                if k == "shift":
                    self.shift = np.float32(value)
            cells, moves = np.concatenate(cells).ravel(), np.concatenate(moves) / len(chosen)
            if len(cells):
                by_cell = np.argsort(cells, kind="stable")
                rows, firsts = np.unique(cells[by_cell], return_index=True)
                g = np.add.reduceat(moves[by_cell // PARTS], firsts, axis=0).astype(np.float32)
                sums["table"][rows] += g * g
                self.table[rows] -= rate * g / np.sqrt(sums["table"][rows])
                touched[rows] += 1
        return touched, -(-len(order) // batch)

    def _params(self) -> dict[str, np.ndarray]:
        return {"table": self.table, "out": self.out, "shift": np.asarray(self.shift), **{f"f{w}": self.filters[w] for w in WIDTHS}, **{f"b{w}": self.bias[w] for w in WIDTHS}}

    def state(self, sums: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each cell, and all others, with their sums of squares."""
        rest = [np.ravel(x[k]) for x in (self._params(), sums) for k in x if k != "table"]
        return np.concatenate((self.table, sums["table"]), 1).astype(float), np.concatenate(rest).astype(float)

    def restore(self, sums: dict[str, np.ndarray], cells: np.ndarray, rest: np.ndarray) -> None:
        """Take ``state`` back."""
        self.table[:], sums["table"][:] = cells[:, :SIZE], cells[:, SIZE:]
        at = 0
        for x in (self._params(), sums):
            for k, v in x.items():
                if k != "table":
                    v[...] = rest[at : at + v.size].reshape(v.shape)
                    at += v.size
                if k == "shift" and x is not sums:
                    self.shift = np.float32(v)

    def calibrate(self, counts: np.ndarray) -> None:
        """A threshold for all and for each language with toxic rows enough: the best F1, in the widest gap.

        ``counts``: rows by language, label and score in ``BINS`` steps.
        """

        def best(k: np.ndarray) -> float:
            bins = np.flatnonzero(k.sum(0))[::-1]
            score, hit = (bins + 0.5) / BINS, np.cumsum(k[1, bins])
            f1 = 2 * hit / (np.cumsum(k[:, bins].sum(0)) + k[1].sum())
            top = np.flatnonzero(f1 >= f1.max() - 1e-12)
            i = max(top, key=lambda i: score[i] - (score[i + 1] if i + 1 < len(score) else 0))
            return float(np.clip((score[i] + (score[i + 1] if i + 1 < len(score) else 0)) / 2, 0.05, 0.95))

        if counts[:, 1].sum():
            self.fallback = best(counts.sum(0))
        for lang, k in zip(LANGS, counts, strict=True):
            if k[1].sum() >= 5 and k[0].sum() >= 5:
                self.thresholds[lang] = best(k)


class Scorer:
    """Scores texts; keeps the vectors of words it has met."""

    def __init__(self, net: Convolution):
        self.net, self.ids = net, {}
        self.vectors = np.zeros((1024, SIZE), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        out = np.fromiter(map(ids.get, words, repeat(0)), np.int64, len(words))
        missing = np.flatnonzero(out == 0).tolist()
        if not missing:
            return out
        new = list({words[k] for k in missing})
        while len(ids) + len(new) >= len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        cells = np.array([parts(w) for w in new])
        at = len(ids) + 1
        self.vectors[at : at + len(new)] = self.net.table[cells].sum(1)
        ids.update(zip(new, range(at, at + len(new)), strict=True))
        out[missing] = [ids[words[k]] for k in missing]
        return out

    def score(self, texts: list[str]) -> list[float]:
        if not self.net.ready:
            return [0.0] * len(texts)
        if len(self.ids) > CACHE:
            self.ids, self.vectors = {}, np.zeros((1024, SIZE), np.float32)
        rows, starts, langs, at = [], [], [], 0
        gap = np.zeros(max(WIDTHS), np.int64)  # row 0 is padding
        for t in texts:
            words = words_of(t)
            langs.append(language(words))
            rows += [self._ids(words), gap]
            starts.append(at)
            at += len(words) + len(gap)
        flat, ends = np.concatenate(rows), [*starts[1:], at]
        out: list[float] = []
        # Documents in groups of about ``WINDOW`` words; one that is longer in stretches that overlap.
        k = 0
        while k < len(texts):
            j = k + 1
            while j < len(texts) and ends[j] - starts[k] <= WINDOW:
                j += 1
            lo, hi = starts[k], ends[j - 1]
            if j == k + 1 and hi - lo > 200_000:
                out.append(self._long(flat[lo:hi]))
            else:
                out += self.net.raw(self.vectors[flat[lo:hi]], np.array(starts[k:j]) - lo).tolist()
            k = j
        return [self.net.stretch(p, lang) for p, lang in zip(out, langs, strict=True)]

    def _long(self, ids: np.ndarray) -> float:
        step, more = 100_000, max(WIDTHS) - 1
        tops = []
        for a in range(0, len(ids), step):
            x = self.vectors[ids[a : a + step + more]]
            if a + step + more >= len(ids):  # only the text's end is padded
                x = np.concatenate((x, np.zeros((more, SIZE), np.float32)))
            tops.append(self.net.sums_of_filters(x).max(0))
        return float(self.net.told(self.net.cut(np.max(tops, 0))))


def _encoded(rows: DataFrame) -> DataFrame:
    """(cells, lang, y, held) of each row (text, y, held), in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            cells, langs = [], []
            known = known if len(known) <= CACHE else {}
            for t in batch.column(0):
                words = words_of(t.as_py() or "")
                for w in set(words).difference(known):
                    known[w] = np.array(parts(w), np.uint16).tobytes()
                cells.append(b"".join(map(known.__getitem__, words)))
                langs.append(LANGS.index(language(words)))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), pa.array(langs, pa.int32()), batch.column(1), batch.column(2)], names=["cells", "lang", "y", "held"])

    return rows.select("text", "y", "held").mapInArrow(run, "cells binary, lang int, y int, held boolean")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Cells [words, PARTS], language and label of each encoded row."""
    for batch in batches:
        for cells, lang, y in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            yield np.frombuffer(cells.as_py(), np.uint16).reshape(-1, PARTS), lang, y


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Documents with each cell, by label, and documents by label."""
    total = np.zeros((2, CELLS + 1), np.int64)
    for cells, _, y in _rows(batches):
        total[y, np.unique(cells)] += 1
        total[y, CELLS] += 1
    return total.ravel()


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Convolution:
    """A network trained and calibrated on all labelled documents."""
    net = Convolution()
    rows, sizes = labelled_rows(docs, labels, label, SHARD)
    if len(sizes) < 2:
        return net
    # Copies of a text are all held or all trained on; a partition has the same rows in the same order at each run.
    held = F.crc32(F.lower("text")) % 5 == 0
    dealt = rows.withColumn("held", held).sortWithinPartitions(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    shards = checkpoint(_encoded(dealt))
    n_shards = shards.rdd.getNumPartitions()
    trained, kept = shards.where("not held"), shards.where("held")

    counts = sum_vectors(trained, _count, 2 * (CELLS + 1), "i8").reshape(2, -1)
    n = counts[:, CELLS]
    if not n.all():
        return net
    share = float(n[1] / n.sum())
    net.seed_table(counts[:, :CELLS].sum(0), counts[1, :CELLS], share)
    sums = net.sums()
    cells, rest = net.state(sums)
    for k in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((net, sums))

        def moved(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> np.ndarray:
            """What a partition moves, times the steps that moved it, and those steps."""
            own = list(_rows(batches))
            if not own:
                return np.zeros(cells_size + CELLS + rest_size + 1, np.int64)
            mine, squares = copy.deepcopy(shared.value)
            before, others = mine.state(squares)
            visits = max(len(own), 2 * VISITS // (ROUNDS * max(2, n_shards)))
            touched, steps = mine.train([r[0] for r in own], np.array([r[2] for r in own], float), share, squares, visits, (9, k, TaskContext.get().partitionId()))
            after, then = mine.state(squares)
            whole = [np.rint((after - before) * touched[:, None] * PART).ravel(), touched, np.rint((then - others) * steps * PART), [steps]]
            return np.concatenate(whole).astype(np.int64)

        cells_size, rest_size = cells.size, rest.size
        total = sum_vectors(trained, moved, cells_size + CELLS + rest_size + 1, "i8")
        gone, touched, turned, steps = np.split(total, [cells_size, cells_size + CELLS, cells_size + CELLS + rest_size])
        cells = cells + gone.reshape(cells.shape) / PART / np.maximum(touched, 1)[:, None]
        rest = rest + turned / PART / steps[0]
        net.restore(sums, cells, rest)
        shared.unpersist()
    net.ready = True

    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, gap = np.zeros((len(LANGS), 2, BINS), np.int64), np.zeros((max(WIDTHS), SIZE), np.float32)
        for x, lang, y in _rows(batches):
            p = shared.value.raw(np.concatenate((shared.value.table[x].sum(1), gap)), np.zeros(1, np.int64))[0]
            total[lang, y, min(int(p * BINS), BINS - 1)] += 1
        return total.ravel()

    width = len(LANGS) * 2 * BINS
    found = sum_vectors(kept, scored, width, "i8").reshape(len(LANGS), 2, BINS)
    if found[:, 1].sum() < 5:  # too few rows held out: calibrate on all
        found = sum_vectors(shards, scored, width, "i8").reshape(len(LANGS), 2, BINS)
    net.calibrate(found)
    return net


def _column(texts, scorer: Scorer) -> pa.Array:
    return pa.array([s for part in slices(texts, CHARS) for s in scorer.score(part)], pa.float64())


def score_toxicity(docs: DataFrame, net: Convolution) -> DataFrame:
    """doc_id and score of each row of ``docs``; toxic from 0.7 on."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(batch.column(1), scorer)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Convolution) -> DataFrame:
    """Rows of ``docs`` that are not toxic, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = pa.array(np.asarray(_column(batch.column(k), scorer)) < AT)
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, learn(*(df.where(~fold("doc_id", 3, 1)) for df in (docs, labels))))
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
