"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: pattern packing by non-negative least squares.  Documents are tokenised once and cut
into pieces of at most ``max_tokens``; the histogram of piece lengths (at most ``max_tokens``
numbers, whatever the input) goes to the driver; patterns of one to three lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, rounded down, and what is left over is packed largest-fit-first
with as many documents a sequence as fit.  The resulting slot table is bounded by the number of
lengths too, so it is broadcast; every piece finds its slot from its rank among the pieces of
its length.

Defined results: a null or empty text is the single end id; very long texts are cut into as many
pieces as they need; rows that repeat are packed as often as they occur, in any order among
themselves; pieces of one length go in order of doc_id, piece, start and checksum; an empty table
gives no rows; columns other than the id and the text are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import checkpoint, read_table

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that one task ranks; a more frequent length is dealt over more tasks.
RANK_ROWS = 200_000
_TOKENIZERS: dict[str, object] = {}


class ByteBpe:
    """Ids of a byte-level BPE file; the rank table of the same vocabulary encodes faster.

    Texts that contain one of the file's added tokens go through the ``tokenizers`` library,
    which alone knows them; all others have the same ids either way (tested).
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    """The worker's tokenizer, loaded once a process."""
    import public_tokenizers

    if json_path is None:
        json_path = public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    key = f"{json_path}|{ranks_path}"
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ByteBpe(json_path, ranks_path)
    return _TOKENIZERS[key]


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one if need be."""
    first = n % max_tokens
    starts = ([0] if first else []) + list(range(first, n, max_tokens))
    return [(s, first if first and s == 0 else max_tokens) for s in starts]


def tokenize_pieces(
    docs: DataFrame,
    max_tokens: int = 1024,
    end_id: int = 2,
    json_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the piece's token ids."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path)
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    part = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(part.tobytes())]
                    for c, v in zip(cols, row + ([part.astype("i4")] if with_ids else []), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    out = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def enumerate_patterns(lengths: np.ndarray, max_tokens: int) -> np.ndarray:
    """All patterns of one to three of ``lengths`` that fill a sequence, as rows a >= b >= c (0: unused).

    There are about max_tokens ** 2 / 12 of them at most, however large the input.
    """
    have = np.zeros(max_tokens + 1, dtype=bool)
    have[lengths] = True
    desc = np.sort(lengths)[::-1]
    out = [np.array([[max_tokens, 0, 0]])] if have[max_tokens] else []
    a = desc[(desc < max_tokens) & (2 * desc >= max_tokens)]
    pairs = np.stack([a, max_tokens - a, 0 * a], 1)
    out.append(pairs[have[pairs[:, 1]]])
    for a in desc[(3 * desc >= max_tokens) & (desc < max_tokens)]:
        rest = max_tokens - a
        b = desc[(desc <= a) & (2 * desc >= rest) & (desc < rest)]
        c = rest - b
        keep = have[c] & (c >= 1)
        out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(out).astype(np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, passes: int = 40) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram.

    Exact coordinate descent: each step solves for one repeat count with the others held.  After
    the first pass only patterns in use are revisited, with a look at all gradients in between,
    so that the answer stays sparse and rounds well.
    """
    x = np.zeros(len(patterns))
    resid = hist.astype(float).copy()
    resid[0] = 0.0
    rows = [tuple(int(v) for v in p if v) for p in patterns]
    norm = [float(sum(p.count(v) ** 2 for v in set(p))) for p in rows]
    r = resid.tolist()

    def sweep(which) -> float:
        moved = 0.0
        for j in which:
            p = rows[j]
            g = 0.0
            for v in p:
                g += r[v]
            old = x[j]
            new = old + g / norm[j]
            if new < 0.0:
                new = 0.0
            if new != old:
                d = new - old
                x[j] = new
                for v in p:
                    r[v] -= d
                moved = max(moved, abs(d))
        return moved

    sweep(range(len(rows)))
    for k in range(passes):
        if k % 8 == 7:
            now = np.array(r)
            grad = now[patterns[:, 0]] + np.where(patterns[:, 1] > 0, now[patterns[:, 1]], 0) + np.where(patterns[:, 2] > 0, now[patterns[:, 2]], 0)
            which = np.flatnonzero((x > 0) | (grad > 0.5))
        else:
            which = np.flatnonzero(x > 0)
        if sweep(which.tolist()) < 0.25:
            break
    return x


def plan_packing(hist: np.ndarray, max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every sequence shape: NNLS patterns first, then the residual."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return plan
    patterns = enumerate_patterns(lengths, max_tokens)
    if len(patterns):
        x = fit_repeats(patterns, hist)
        # Round down, the largest repeats first, never beyond what is there; the residual pass
        # takes up the fractions.
        for j in np.argsort(-x, kind="stable"):
            p = tuple(int(v) for v in patterns[j] if v)
            rep = int(min([np.floor(x[j]), *(left[v] // p.count(v) for v in p)]))
            if rep < 1:
                continue
            plan.append((p, rep))
            for v in p:
                left[v] -= rep
    # Residuals: fill each sequence with the largest pieces that fit, as often as counts allow.
    while left.any():
        shape: list[int] = []
        room = max_tokens
        used: dict[int, int] = {}
        while room > 0:
            can = np.flatnonzero(left[: room + 1])
            can = can[[left[v] > used.get(int(v), 0) for v in can]] if used and len(can) else can
            if not len(can):
                break
            v = int(can[-1])
            shape.append(v)
            used[v] = used.get(v, 0) + 1
            room -= v
        rep = int(min(left[v] // k for v, k in used.items()))
        plan.append((tuple(shape), rep))
        for v, k in used.items():
            left[v] -= rep * k
    return plan


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length << 44 | first rank), first sequence and offset of each run of slots."""
    key, seq, off = [], [], []
    taken: dict[int, int] = {}
    base = 0
    for shape, rep in plan:
        at = 0
        for v in shape:
            key.append((v << 44) | taken.get(v, 0))
            seq.append(base)
            off.append(at)
            taken[v] = taken.get(v, 0) + rep
            at += v
        base += rep
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    return tuple(np.array(a, dtype=np.int64)[order] for a in (key, seq, off))


def pack_pieces(pieces: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """Give each row of ``pieces`` (doc_id, piece, length, ...) a sequence_id and an offset.

    ``pieces`` must be stable when read again (a table or a checkpoint).
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    hist = np.zeros(max_tokens + 1, dtype=np.int64)
    for v, n in counts.items():
        hist[v] = n
    slots = pieces.sparkSession.sparkContext.broadcast(slot_table(plan_packing(hist, max_tokens)))
    n_buckets = max(1, -(-int(hist.max()) // RANK_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, off = slots.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            want = (length.astype(np.int64) << 44) | rank
            k = np.searchsorted(key, want, side="right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(seq[k] + want - key[k]), pa.array(off[k])],
                names=[*names, "sequence_id", "offset"],
            )

    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int")
    dealt = pieces.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns])
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(first, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_row") - 1).cast("long").alias("_rank"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, max_tokens: int = 1024, **tokens) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row a piece with its sequence and offset."""
    return pack_pieces(checkpoint(tokenize_pieces(docs, max_tokens, **tokens)), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """Token arrays of whole sequences, from pieces packed ``with_ids=True``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), max_tokens=1024, end_id=2)
