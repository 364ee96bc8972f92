"""SimHash fingerprints and their near-duplicate classes.

Method: generalised pigeonhole over Hamming space.  The 64 bits are grouped into a few
partitions so that correlated bits stand together; each partition gets its own threshold, chosen
by dynamic programming on estimated probe and candidate counts, so that two fingerprints within
``max_bits`` must lie within the threshold of at least one partition.  Fingerprints are indexed
by their partition values, probed with the values within the threshold, and candidates are
verified by counting differing bits.  Exact repeats are one fingerprint from the start; crowded
index values go to a kernel that returns a spanning forest in blocks of bounded size instead of
all pairs, so no link between different fingerprints is lost and no bucket is capped.

Defined results: a null, empty or blank text has fingerprint zero and links like any other;
repeated rows return repeated rows; a null doc_id never names a component unless all its members
are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import checkpoint, fresh, read_table, rested, sum_vectors
from cloudloom.llm.rounds import link_rounds, meeting
from cloudloom.operators.graph import connected_components, stored

#: Index entries of one key beyond which its bucket goes to the kernel.
CROWD = 64
#: Members of a bucket that one kernel call compares; larger buckets are cut into blocks.
BLOCK = 20_000
#: Rows of a table up to which it may be broadcast.
BROADCAST_ROWS = 200_000
#: Differing bits that the word fingerprints of near-duplicates may have: all 64, so similarity alone decides.
MAX_BITS = 64
#: Columns of 64 cells each that tell in which an odd number of a text's shingles lies.
ODD = ("odd0", "odd1", "odd2", "odd3")
#: Least shared shingles of a text that tell at which of them a pair of texts meets first.
LEADS = ("lead0", "lead1", "lead2", "lead3")
#: Cells of word counts; words that a task remembers.
CELLS, CACHE = 1 << 18, 200_000
#: Cells of shingle counts, by which common shingles are told from rare ones.
SHINGLE_CELLS = 1 << 20


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of ``text`` over word shingles, each as heavy as the times it occurs; unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 50_000):
        hashes = np.fromiter(
            (xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[k : k + 50_000], stops[k : k + 50_000], strict=True)), np.dtype("<u8")
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(_row, doc_id, fp) of each row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["_row", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "_row long, doc_id long, fp long")


def bit_statistics(reps: DataFrame) -> tuple[float, np.ndarray]:
    """Number of fingerprints and, over all of them, how often each pair of bits is set together."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(64 * 64 + 1, dtype=np.float64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            total[:-1] += (bits.T @ bits).ravel()
            total[-1] += len(bits)
        return total

    total = sum_vectors(reps.select("fp"), tally, 64 * 64 + 1)
    return float(total[-1]), total[:-1].reshape(64, 64)


def group_bits(both: np.ndarray, n: float, m: int) -> list[list[int]]:
    """m groups of bits, each grown by the bit most correlated with those already in it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        pool = sorted(left)
        group = [pool[int(np.argmax(corr[np.ix_(pool, pool)].sum(1)))]]
        while len(group) < size:
            pool = sorted(left - set(group))
            group.append(pool[int(np.argmax(corr[np.ix_(pool, group)].sum(1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def allocate(groups: list[list[int]], p: np.ndarray, n: float, max_bits: int) -> tuple[float, list[int]]:
    """Least estimated cost and thresholds (-1: not searched) with sum(t + 1) = max_bits + 1."""
    costs = []
    for bits in groups:
        agree = p[bits] ** 2 + (1 - p[bits]) ** 2
        dist = np.zeros(max_bits + 1)  # distribution of the differing bits of two fingerprints
        dist[0] = 1
        for a in agree:
            dist = dist * a + np.concatenate(([0], dist[:-1])) * (1 - a)
        within = np.cumsum(dist)
        probes = np.cumsum([comb(len(bits), t) for t in range(max_bits + 1)])
        costs.append([0.0] + [n * (1 + (probes[t] - 1) / 2) + n * n / 2 * within[t] for t in range(max_bits + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for take in range(max_bits + 2 - used):
                cand = (cost + c[take], [*ts, take - 1])
                if used + take not in nxt or cand[0] < nxt[used + take][0]:
                    nxt[used + take] = cand
        best = nxt
    return best[max_bits + 1]


def choose_partitions(n: float, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """Bit groups and thresholds of the cheapest of two to ``max_bits + 1`` partitions."""
    p = np.diag(both) / max(n, 1)
    plans = []
    for m in range(2, max_bits + 2):
        groups = group_bits(both, n, m)
        cost, ts = allocate(groups, p, n, max_bits)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keyed(reps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, probe) and all columns of ``reps``: each row at its fingerprint's own values and, as a probe, at near ones.

    Of two different values only the one whose highest differing bit is clear probes the other.
    """
    rows = []
    for part, (bits, t) in enumerate(plan):
        mask = sum(1 << b for b in bits)
        for k in range(t + 1):
            for flip in combinations(bits, k):
                top = 1 << max(flip) if flip else 0
                rows.append((part, _signed(mask), _signed(sum(1 << b for b in flip)), _signed(top)))
    probes = F.array([F.struct(F.lit(a).alias("part"), F.lit(b).cast("long").alias("mask"), F.lit(c).cast("long").alias("flip"), F.lit(d).cast("long").alias("top")) for a, b, c, d in rows])
    fp, q = F.col("fp"), F.col("q")
    return (
        reps.select("*", F.explode(probes).alias("q"))
        .where(fp.bitwiseAND(q["top"]) == 0)
        .select(q["part"].alias("part"), fp.bitwiseAND(q["mask"]).bitwiseXOR(q["flip"]).alias("key"), *reps.columns, (q["flip"] != 0).alias("probe"))
    )


def forest(index: np.ndarray, other: np.ndarray, same: bool, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is within ``max_bits``, between ``index`` and both, no cycle among them.

    Breadth-first: each reached member is held against those not yet reached, so a tight group
    costs its size times what its first members miss.  ``same``: links within ``index`` count.
    """
    nodes = np.concatenate((index, other)).view(np.uint64)
    is_index = np.arange(len(nodes)) < len(index)
    left = np.arange(len(nodes))  # not reached yet
    edges: list[tuple[int, int]] = []
    for seed in range(len(index)):
        if len(left) == 0:
            break
        if left[np.searchsorted(left, seed) % len(left)] != seed:
            continue
        left = left[left != seed]
        queue = [seed]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[u]) <= max_bits
            if not is_index[u]:
                near &= is_index[left]
            elif not same:
                near &= ~is_index[left]
            got = left[near]
            if len(got):
                edges += [(int(nodes[u].view(np.int64)), int(nodes[v].view(np.int64))) for v in got]
                queue += got.tolist()
                left = left[~near]
    return edges


def links(reps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``reps`` (distinct, stable) within ``max_bits``."""
    n, both = bit_statistics(reps)
    if n < 2:
        return reps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = keyed(reps, choose_partitions(n, both, max_bits))
    index = rows.where("not probe")
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    crowded = checkpoint(sizes.where(F.col("size") > CROWD))
    n_crowded = crowded.count()
    few = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits

    thin = lambda df: df.join(few.drop("size"), ["part", "key"], "left_anti") if n_crowded else df
    left = thin(index).select("part", "key", F.col("fp").alias("a"))
    right = thin(rows).select("part", "key", F.col("fp").alias("b"), "probe")
    pairs = left.join(right, ["part", "key"]).where(differ & (F.col("probe") | (F.col("a") < F.col("b")))).select("a", "b")
    if not n_crowded:
        return pairs

    # A crowded key: its index in chunks i, all its rows in chunks j, one kernel call for (i, j).
    cut = rows.join(few, ["part", "key"]).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    cut = cut.withColumn("c", chunk)
    as_index = cut.where("not probe").select("part", "key", "fp", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("n") - 1)).alias("j"), F.lit(True).alias("index"))
    others = cut.select("part", "key", "fp", "probe", "c", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("n") - 1).otherwise(F.col("c")))).alias("i"))
    as_other = others.where("probe or i <> c").select("part", "key", "fp", "i", F.col("c").alias("j"), F.lit(False).alias("index"))
    # A probe chunk may have a larger number than the index chunk's last copy, or a smaller one.
    back = cut.where("not probe").select("part", "key", "fp", F.col("c").alias("i"), F.explode(F.sequence(F.lit(0), F.col("c"))).alias("j"), F.lit(True).alias("index")).where("j < i")

    def join_block(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        ix = table.column("index").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        edges = forest(fp[ix], fp[~ix], i == j, max_bits)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    blocks = as_index.unionByName(back).unionByName(as_other)
    dense = blocks.groupBy("part", "key", "i", "j").applyInArrow(join_block, "a long, b long")
    return pairs.unionByName(dense)


def _classes(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of every fingerprint; root names its class."""
    reps = checkpoint(fps.select("fp").distinct())
    comps = connected_components(links(reps, max_bits)).withColumnRenamed("node", "fp")
    return reps.join(comps, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, max_bits: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links) of every row of ``docs``."""
    fps = checkpoint(fingerprints(docs, width, seed).drop("_row"))
    roots = _classes(fps, max_bits)
    least = roots.join(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(roots.join(least, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a text's words, ascending."""
    from xxhash import xxh64_intdigest

    found = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    out = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)
    out.sort()
    return out


class WordHashes:
    """Hashes of words, remembering those met."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def counted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the different words of a text, and how often each occurs."""
        from xxhash import xxh64_intdigest

        if len(self.known) > CACHE:
            self.known = {}
        known, times = self.known, Counter(words)
        for w in times:
            if w not in known:
                known[w] = xxh64_intdigest(w, 42)
        return np.fromiter(map(known.__getitem__, times), np.uint64, len(times)), np.fromiter(times.values(), float, len(times))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % CELLS


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bits that outweigh in ``hashes``, as a signed long; zero without any."""
    total = np.zeros(64)
    for k in range(0, len(hashes), 50_000):
        bits = np.unpackbits(hashes[k : k + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64) * 2.0 - len(bits) if weights is None else weights[k : k + 50_000] @ (bits * 2.0 - 1)
    return int(np.packbits(total > 0, bitorder="little").view("<i8")[0])


def odd_cells(hashes: np.ndarray) -> list[int]:
    """Cells with an odd number of ``hashes``, as signed longs.

    Two sets differ in at least as many members as their cells do, so this never spares a pair
    of alike sets.
    """
    n = 64 * len(ODD)
    odd = np.bincount(hashes & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def word_weights(docs: DataFrame) -> np.ndarray:
    """Weight of each word cell: the root of the log of how rare its words are among all rows (text)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, total = WordHashes(), np.zeros(CELLS + 1)
        for batch in batches:
            for t in batch.column(0):
                total[np.unique(_cells(words.counted(_words(t.as_py()))[0]))] += 1
            total[-1] += batch.num_rows
        return total

    total = sum_vectors(docs.select("text"), tally, CELLS + 1)
    return np.sqrt(np.log((total[-1] + 1) / np.maximum(total[:-1], 1))).astype(np.float32)


def described(docs: DataFrame, weights: np.ndarray | None, width: int, counts: np.ndarray | None = None, similarity: float = 0.8) -> DataFrame:
    """(_row, doc_id, d1, d2, size, fp, ODD, first) of each row (_row, doc_id, text).

    d1, d2 and size tell the set of shingles; fp is the SimHash of the text's words by weight (without
    ``weights``: zero), ODD its odd cells, first its ``prefix`` (without ``counts``: none).
    """
    names = ["d1", "d2", "size", "fp", *ODD]
    shared = docs.sparkSession.sparkContext.broadcast((weights, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (weights, counts) = WordHashes(), shared.value
        for batch in rested(batches):
            cols: list[list[int]] = [[] for _ in names]
            firsts = []
            for t in batch.column(2):
                words = _words(t.as_py())
                fp = 0
                if weights is not None:
                    hashes, times = known.counted(words)
                    fp = _majority(hashes, times * weights[_cells(hashes)])
                s = shingles(words, width)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                row = np.frombuffer(d, "<i8").tolist() + [len(s), fp, *odd_cells(s)]
                firsts.append(s[:0] if counts is None else prefix(s, counts, similarity))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols], pa.array(firsts, pa.list_(pa.int64()))], names=["_row", "doc_id", *names, "first"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in ["_row", "doc_id", *names]) + ", first array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, payload): the ascending hashes of the word shingles of each row (_row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rested(batches):
            sets = [shingles(_words(t.as_py()), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "payload"])

    return docs.select("_row", "text").mapInArrow(run, "node long, payload array<long>")


def jaccard_at_least(similarity: float) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Whether two ascending sets have that Jaccard similarity (none and none: 1)."""

    def same(x: np.ndarray, y: np.ndarray) -> bool:
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
        union = len(x) + len(y) - both
        return union == 0 or both >= union * similarity

    return same


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many rows (text) have shingles in each of ``SHINGLE_CELLS`` cells."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SHINGLE_CELLS, np.int32)
        for batch in rested(batches):
            for t in batch.column(0):
                total[_shingle_cells(shingles(_words(t.as_py()), width))] += 1
        return total

    return sum_vectors(docs.select("text"), tally, SHINGLE_CELLS, "i4")


def _shingle_cells(hashes: np.ndarray) -> np.ndarray:
    return hashes & (SHINGLE_CELLS - 1)


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's ``hashes``, so many that two sets of that Jaccard similarity share one.

    Both share ``similarity`` times the larger set at least, so in any order that all sets keep to,
    one of those stands among the first of each.  The order is by ``counts`` of cells.
    """
    n = len(hashes) - ceil(similarity * len(hashes) - 1e-6) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, counts[_shingle_cells(hashes)]))[:n]]


def similar_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, max_bits: int) -> DataFrame:
    """(a, b): links that connect all ``nodes`` (node, first, size, ODD) whose texts (_row, text) are that similar.

    Candidates are nodes that share one of their ``first`` shingles (``prefix``): every similar
    pair does, and a node has rows in proportion to its text however many nodes there are.  A
    shingle of one node meets nothing and is left out.  Sizes and odd cells spare pairs that cannot be
    similar, and the sets of shingles decide.  Under 64 ``max_bits``, word fingerprints (fp, which
    ``nodes`` must have then) that differ in more are no link.

    A pair counts at the least shingle that both share and at no other that its ``LEADS`` tell to be
    later: in none that comes before, so it is never lost, and of a family's pairs one row is made, not
    one for each shared shingle.
    """
    rows = stored(meeting(nodes.select("node", F.explode("first").alias("key"))))
    least = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, len(LEADS)).alias("least"))
    leads = least.select("node", *[F.coalesce(F.get("least", F.lit(k)), F.get("least", F.lit(0))).alias(c) for k, c in enumerate(LEADS)])
    index = stored(rows.join(nodes.drop("first").join(leads, "node"), "node").withColumn("probe", F.lit(False)))

    def close(p, q) -> Column:
        alike = F.least(p("size"), q("size")) >= similarity * F.greatest(p("size"), q("size")) - 1e-6
        differ = reduce(add, [F.bit_count(p(c).bitwiseXOR(q(c))) for c in ODD])
        alike &= differ <= (1 - similarity) / (1 + similarity) * (p("size") + q("size")) + 1e-6
        met = reduce(or_, [(p(c) < F.col("key")) & reduce(or_, [p(c) == q(d) for d in LEADS]) for c in LEADS])
        if max_bits < 64:
            alike &= F.bit_count(p("fp").bitwiseXOR(q("fp"))) <= max_bits
        return alike & ~met

    load = lambda names: shingle_sets(texts.join(names.select(F.col("node").alias("_row")), "_row", "left_semi"), width)
    return link_rounds(index, close, load, jaccard_at_least(similarity))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class of near-duplicates, the one of least doc_id, with all its columns.

    Two texts link if their sets of word shingles of ``width`` have at least that Jaccard
    similarity; no such pair is left out.  Under 64 ``max_bits``, links ask of the SimHashes of their
    words, weighted by rarity, to differ in no more, too.  Texts of equal sets are one node.

    Ties: of rows of one doc_id the first as read stays; a null doc_id yields to any other.
    ``docs`` must give the same rows in the same partitions when read again (a table does).
    """
    (row,) = fresh(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    texts = rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = ["size", *ODD] if max_bits >= 64 else ["fp", "size", *ODD]
    weights = None if max_bits >= 64 else word_weights(texts)
    known = stored(described(texts, weights, width, shingle_counts(texts, width), similarity))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row", *told, "first")).alias("least")
    nodes = stored(known.groupBy("d1", "d2").agg(least).select("least.*").withColumnRenamed("_row", "node"))
    comps = connected_components(similar_links(nodes.select("node", "first", *told), texts, width, similarity, max_bits))
    roots = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("component", "node"))
    stay = roots.groupBy("root").agg(F.min(F.struct("unknown", "doc_id", "node")).alias("first")).select(F.col("first.node").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their classes of at most 3 differing bits a link."""
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
