"""Language identification: script ranges, then Viterbi over per-word scores.

The script of a word leaves only the languages seen in that script; among them each word is
scored by hashed letter n-grams (with word ends, and the whole word).  A Viterbi pass with a
penalty for each switch labels the words of a text, so that mixed texts fall into spans, and the
language with the most letters is the text's.  The pass runs through the whole text, however long:
its memory is about ten bytes for each word and language of the longest text of a task.

The model holds every language of the table, each counted on a bounded sample of its texts
(``sample_rows`` a language, those least in hash order; copies are one), whole texts, in cells of fixed number.

Defined results: a null text or one without letters is ``und`` with score 0; a word in a script
that no learned language uses counts for none; with nothing to learn from all is ``und``;
of languages with equally many letters the first by name is taken; repeated rows are rows of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import fold, read_table, slices

WORD = re.compile(r"[^\W\d_]+")
CELLS = 1 << 16
CACHE = 300_000
#: First code points of script ranges, and the scripts.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [a for a, _ in RANGES]
SCRIPTS = sorted({s for _, s in RANGES})


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Cells of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % CELLS


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, cell) of every n-gram of two to four letters with word ends and of whole words; last letters.

    All words are hashed together, as one array of code points.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(code))
    at, found = [], []
    for n in (2, 3, 4):
        h = np.zeros(max(0, len(code) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
        ok = left[: len(h)] >= n
        at.append(word[: len(h)][ok])
        found.append(_mixed(h[ok] * np.uint64(8) + np.uint64(n)))
    place = np.arange(len(code)) - (ends - lengths)[word]
    whole = np.add.reduceat(code * _POWERS[place % len(_POWERS)], ends - lengths)
    at.append(np.arange(len(words)))
    found.append(_mixed(whole * np.uint64(8)))
    return np.concatenate(at), np.concatenate(found), code[ends - 2].astype(np.int64)


def scripts(last: np.ndarray) -> np.ndarray:
    """Script number of words by their last letters."""
    return np.array([SCRIPTS.index(s) for _, s in RANGES])[np.searchsorted(_STARTS, last, side="right") - 1]


class Model:
    """Log scores of cells by language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, in_script: np.ndarray):
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * CELLS)
        logs = np.log(p)
        self.logs = (logs - logs.sum(1, keepdims=True) / max(1, len(langs))).astype(np.float32)
        self.allowed = in_script / np.maximum(in_script.sum(0, keepdims=True), 1) >= 0.001

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of words by language, at most 8 below the best, and which words count for any."""
        at, cell, last = cells(words)
        s = np.stack([np.bincount(at, self.logs[cell, k], len(words)) for k in range(len(self.langs))], 1)
        ok = self.allowed[scripts(last)]
        letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
        s = np.where(ok, s, -1e9)
        return np.maximum(s - s.max(1, keepdims=True), -8.0).astype(np.float32), ok.any(1) & letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``scores`` holds chunks of words one after another."""
    order = np.argsort(-lengths, kind="stable")
    lens, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    n_labels = scores.shape[1]
    state = np.zeros((len(lens), n_labels), np.float32)
    best_from = np.zeros(len(scores), np.int32 if n_labels > 256 else np.uint8)
    stays = np.zeros((len(scores), n_labels), bool)
    live = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
    for t, a in enumerate(live):
        at = starts[:a] + t
        now = state[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top] - penalty
        stay = now >= jump[:, None]
        best_from[at] = top
        stays[at] = stay
        state[:a] = np.where(stay, now, jump[:, None]) + scores[at]
    labels = np.zeros(len(scores), best_from.dtype)
    last = state.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        a = live[t]
        at = starts[:a] + t
        labels[at] = last[:a]
        keep = stays[at, last[:a]]
        last[:a] = np.where(keep, last[:a], best_from[at])
    return labels


class Reader:
    """Labels the words of texts; keeps the scores of words it has met."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.n = 0
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Score words that were not met yet."""
        scores, counts = self.model.score(words)
        while self.n + len(words) > len(self.table):
            self.table, self.letters = np.concatenate((self.table, self.table)), np.concatenate((self.letters, self.letters))
        new = np.full(len(words), -1)
        new[counts] = self.n + np.arange(counts.sum())
        self.ids.update(zip(words, new.tolist(), strict=True))
        self.table[self.n : self.n + counts.sum()] = scores[counts]
        self.letters[self.n : self.n + counts.sum()] = [len(w) for w, c in zip(words, counts, strict=True) if c]
        self.n += int(counts.sum())

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, labels, letters) of each text: labels are language numbers, -1 for words that count for none."""
        wide = max(1, len(self.model.langs) // 16)
        if self.n > CACHE // wide or len(self.ids) > 2 * CACHE // wide:
            self._clear()
        words = [WORD.findall(t.lower()) for t in texts]
        if not self.model.langs:
            return [(w, np.full(len(w), -1), np.zeros(len(w), np.int64)) for w in words]
        new = list(set().union(*words).difference(self.ids))
        step = max(1, 50_000 // wide)
        for k in range(0, len(new), step):
            self._learn(new[k : k + step])
        ids = [np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)) for w in words]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        good = flat >= 0
        labels = np.full(len(flat), -1)
        counted = [int(g) for g in np.add.reduceat(np.concatenate((good, [False])), np.cumsum([0, *map(len, ids)])[:-1])] if len(flat) else []
        counted = [c if len(i) else 0 for c, i in zip(counted, ids, strict=True)] if counted else []
        lengths = [c for c in counted if c]
        if lengths:
            labels[good] = viterbi(self.table[flat[good]], np.array(lengths), self.penalty)
        letters = np.where(good, self.letters[flat], 0)
        cuts = np.cumsum([len(i) for i in ids])[:-1]
        return list(zip(words, np.split(labels, cuts), np.split(letters, cuts), strict=True))


def learn(docs: DataFrame, sample_rows: int = 6000) -> Model:
    """A model of every language of ``docs`` from at most ``sample_rows`` different texts of each, whole."""
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # The texts of each language least in hash order.  A count of different hashes gives a bound that leaves about
    # twice as many as wanted, so only those are ranked; copies of a text are one.
    known = known.withColumn("h", F.xxhash64("text", "lang"))
    share = F.least(F.lit(2.0 * sample_rows) / F.approx_count_distinct("h", 0.02), F.lit(1.0))
    edges = known.select("lang", "h").groupBy("lang").agg((F.lit(-(2.0**63)) + share * 2.0**64).alias("edge"))
    near = known.join(F.broadcast(edges), "lang").where(F.col("h").cast("double") <= F.col("edge"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("lang", "h")
    sample = near.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")
    width = CELLS + len(SCRIPTS)
    counts = "lang string, counts binary"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["lang", "counts"])

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = total.setdefault(lang, np.zeros(width))
                words = WORD.findall(t.as_py().lower())
                if words:
                    _, cell, last = cells(words)
                    np.add.at(v, cell, 1)
                    np.add.at(v, CELLS + scripts(last), 1)
                if len(total) > 64:
                    yield out()
                    total.clear()
        yield out()

    def together(table: pa.Table) -> pa.Table:
        v = np.zeros(width)
        for x in table.column("counts"):
            v += np.frombuffer(zlib.decompress(x.as_py()))
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())})

    found = {r[0]: np.frombuffer(zlib.decompress(bytes(r[1]))) for r in sample.mapInArrow(tally, counts).groupBy("lang").applyInArrow(together, counts).collect()}
    langs = sorted(found)
    total = np.stack([found[lang] for lang in langs], 1) if langs else np.zeros((width, 0))
    return Model(langs, total[:CELLS], total[CELLS:])


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, batch_words: int = 2_000_000) -> DataFrame:
    """doc_id, lang_pred, score (share of letters) and spans (language: letters) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, penalty)
        for batch in batches:
            langs, scores, shares = [], [], []
            for texts in slices(batch.column(1), batch_words * 6 // max(1, len(reader.model.langs) // 4)):
                for _, labels, letters in reader.label(texts):
                    counted = labels >= 0
                    share = np.bincount(labels[counted], letters[counted], len(reader.model.langs)).astype(int).tolist()
                    named = [(lang, v) for lang, v in zip(reader.model.langs, share, strict=True) if v]
                    best = max(named, key=lambda x: x[1], default=("und", 0))  # of equals the first in order
                    langs.append(best[0])
                    scores.append(best[1] / max(1, sum(share)))
                    shares.append(named)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.int64()))],
                names=["doc_id", "lang_pred", "score", "letters"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, letters map<string,long>")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~fold("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
