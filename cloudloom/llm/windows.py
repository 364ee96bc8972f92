"""Concatenate and cut: all documents end to end, cut into fixed windows of tokens.

Method: two passes.  The first tokenises each document once and keeps, beside its ids, how many
tokens stand before it in its partition; the sums of the partitions then get prefix sums, which
makes each document's place in the whole stream known.  The second cuts every document where a
window begins.  Windows are ``max_tokens`` long; what is left after the last full one is cut into
lengths that are powers of two, since such sequences need no padding, so nothing is padded at all.

Nothing is shuffled but one row for each partition.  Partitions are numbered and counted inside
the rows that are written, so a repeated task or a lost executor cannot shift what follows.

Defined results: a null or empty text is the single end id; a document of any length is cut into as
many pieces as windows it touches; documents stand in the order in which they are read; repeated
rows are packed as often as they occur; rows without a doc_id are packed with a null one; an empty
table gives no rows; columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import read_table
from cloudloom.operators.graph import stored

#: Characters that are tokenised before their rows are handed on.
SLICE_CHARS = 4_000_000
#: Partitions whose prefix sums are broadcast; more are joined.
BROADCAST_PARTITIONS = 1_000_000
#: Partitions that one task of the first level of prefix sums adds up.
LEVEL = 1024
#: The word pattern of the vocabulary file (letters, numbers and white space as classes), and its mark of a word's end.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
WORD_END = "</w>"
_MARK = "\x01"
_PLAIN = [chr(c) for c in range(0x130)]
_OTHER = re.compile(f"[^{_PLAIN[0]}{_PLAIN[2]}-{_PLAIN[-1]}]")
_TOKENIZERS: dict[str, WordBpe] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, then U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def word_pattern() -> re.Pattern:
    """``WORD`` for letters below U+0130, with its classes written out from their Unicode categories."""
    kind = {c: unicodedata.category(c)[0] for c in _PLAIN}
    classes = {k: "".join(re.escape(c) for c in _PLAIN if kind[c] == k) for k in "LN"}
    return re.compile(WORD.format(**classes, S=r"\t-\r \x85\xa0"))


class WordBpe:
    """Ids, as little-endian 32-bit bytes, of a lower-casing BPE file with word ends.

    Texts of Latin letters below U+0130 without the mark or an added token are split
    by the file's own pattern and encoded by ranks, each word with a mark for its end; all other
    texts go through the ``tokenizers`` library.  The ids are the same either way (tested).
    """

    def __init__(self, json_path: str):
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model["added_tokens"]}
        letters, ranks = byte_letters(), {}
        for token, number in model["model"]["vocab"].items():
            if token in added:
                continue
            ends = token.endswith(WORD_END)
            core = bytes(letters[c] for c in (token[: -len(WORD_END)] if ends else token))
            ranks[core + _MARK.encode() * ends] = number
        self.json_path, self.added = json_path, tuple(added)
        self.words = word_pattern().findall
        self.fast = tiktoken.Encoding("word_bpe", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The file as its library reads it, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> list[int]:
        if _OTHER.search(text) or any(t in text for t in self.added):
            return self.full.encode(text, add_special_tokens=False).ids
        words = self.words(text.lower())
        return self.fast.encode_ordinary(_MARK.join(words) + _MARK) if words else []


def tokenizer(json_path: str | None = None) -> WordBpe:
    """The worker's tokenizer, loaded once a process."""
    if json_path is None:
        import public_tokenizers

        json_path = public_tokenizers.path("word_bpe_49k.json")
    if json_path not in _TOKENIZERS:
        _TOKENIZERS[json_path] = WordBpe(json_path)
    return _TOKENIZERS[json_path]


def tokenized(docs: DataFrame, end_id: int = 2, json_path: str | None = None) -> DataFrame:
    """(part, before, doc_id, n, ids): each document's ids with its partition and the tokens before it there."""
    schema = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = tokenizer(json_path), TaskContext.get().partitionId(), 0

        def rows(names: list, held: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal before
            n = np.array([len(x) for x in held], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(names, pa.int64()), pa.array(n), ids], schema=schema)

        for batch in batches:
            names, held, chars = [], [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                names.append(name)
                held.append(np.array([*encode(text), end_id], np.int32))
                chars += len(text)
                if chars > SLICE_CHARS:
                    yield rows(names, held)
                    names, held, chars = [], [], 0
            if names:
                yield rows(names, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part long, before long, doc_id long, n long, ids array<int>")


def partition_starts(rows: DataFrame) -> DataFrame:
    """(part, base): tokens in all partitions before each, by prefix sums on two levels.

    A task of the first level adds up ``LEVEL`` partitions; the second level has one row for each.
    """
    totals = rows.groupBy("part").agg(F.sum("n").alias("tokens")).withColumn("level", F.expr(f"part div {LEVEL}"))
    levels = totals.groupBy("level").agg(F.sum("tokens").alias("tokens"))
    own, first = (F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for w in (Window.partitionBy("level").orderBy("part"), Window.orderBy("level")))
    return totals.withColumn("own", own).join(levels.select("level", first.alias("first")), "level").select("part", (F.col("first") + F.col("own")).alias("base"))


def tail_lengths(rest: int) -> list[int]:
    """Powers of two that add up to ``rest``, the largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Cuts:
    """Where the windows of a stream of ``total`` tokens begin."""

    def __init__(self, total: int, max_tokens: int):
        self.total, self.width, self.full = total, max_tokens, total // max_tokens
        self.tail = self.full * max_tokens + np.concatenate(([0], np.cumsum(tail_lengths(total % max_tokens)))).astype(np.int64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The window that holds each place of the stream."""
        return np.where(at < self.tail[0], at // self.width, self.full + np.searchsorted(self.tail, at, side="right") - 1)

    def start(self, window: np.ndarray) -> np.ndarray:
        """The place at which each window begins; of the window after the last, the end of the stream."""
        return np.where(window < self.full, window * self.width, self.tail[np.clip(window - self.full, 0, len(self.tail) - 1)])


def concatenate_and_cut(docs: DataFrame, max_tokens: int = 4096, end_id: int = 2, json_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset, last).

    ``start`` is the place in the document, ``offset`` that in the sequence; ``last`` marks the piece that
    ends its document, so that a piece with start > 0 or without ``last`` goes on across a window's
    boundary.  ``with_ids`` adds the piece's ids.
    """
    rows = stored(tokenized(docs, end_id, json_path))
    starts = partition_starts(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    few = rows.select("part").distinct().count() <= BROADCAST_PARTITIONS
    placed = rows.join(F.broadcast(starts) if few else starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    cuts = Cuts(int(total), max_tokens)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("last", pa.bool_())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            if not len(at):
                continue
            lists = batch.column(3)
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            first, last = cuts.window(at), cuts.window(at + n - 1)
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            window = first[doc] + piece
            opens = cuts.start(window)
            begin, end = np.maximum(at[doc], opens), np.minimum((at + n)[doc], cuts.start(window + 1))
            start, length = begin - at[doc], end - begin
            low = offsets[:-1][doc].astype(np.int64) + start
            data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(begin - opens), pa.array(end == (at + n)[doc])]
            if with_ids:
                cols.append(pa.array([ids[a:b] for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, last boolean"
    return placed.mapInArrow(run, out + (", ids array<int>" if with_ids else ""))


def boundaries(packed: DataFrame) -> DataFrame:
    """One record for each sequence: its tokens, pieces and first and last document, and which of these reach beyond it."""
    ends = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"),
        F.min_by(F.struct("doc_id", (F.col("start") > 0).alias("cut")), "offset").alias("head"), F.max_by(F.struct("doc_id", (~F.col("last")).alias("cut")), "offset").alias("foot"),
    )
    return ends.select("sequence_id", "tokens", "pieces", F.col("head.doc_id").alias("first_doc"), F.col("head.cut").alias("begins_inside"), F.col("foot.doc_id").alias("last_doc"), F.col("foot.cut").alias("ends_inside"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """All documents end to end in windows of 4096 tokens."""
    return concatenate_and_cut(read_table(spark, sf_dir, "documents"), max_tokens=4096, end_id=2)
