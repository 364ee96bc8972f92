"""Hard-negative mining: for anchors and their positives, the best rows of other labels in a range of scores.

Method: a pivot table.  Each row x gets one more component, sqrt(M^2 - |x|^2) with M the largest
norm, and each anchor q a zero there; then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so a range of inner
products is a range of distances.  The table stores each row's distances to a few pivots, sorted by
nearest pivot and the distance to it, so that rows lie in chunks with narrow ranges of distances.  By
the triangle inequality an anchor's and a chunk's pivot distances bracket all scores between them;
chunks whose bracket misses the range go, in the others the ring around the chunk's own pivot leaves
a run of rows, and those survivors are scored exactly.

The anchors are a stated query set: they go in blocks of ``BLOCK`` rows, each block broadcast and held
against the whole table in one scan without a shuffle.  Tasks keep the best ``k`` rows of each range
and raise the lower end of the range as they find better ones; it starts at what a bounded sample
(``SAMPLE_ROWS``, least in hash order, also the source of pivots) gives.  The sample only
saves work: results are exact for any sample and any pivots.

Defined results: rows with a null vec_id, label or vector or with a null, NaN or infinite component take
no part; a vector shorter than another counts as if it ended in zeros; rows that repeat a vec_id are rows
of their own (each such anchor has its own lists, the other copies are its other rows); ties go to
the smaller vec_id; an anchor without positives, and a positive without negatives in its range,
gives no rows; an empty table gives none; other columns are ignored.  Scores must fit 63 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import read_table
from cloudloom.operators.graph import checkpoint_folder, stored

#: Anchors that are broadcast at once.
BLOCK = 8192
#: Rows that pivots are chosen from and that first bounds come from.
SAMPLE_ROWS = 4096
PIVOTS = 16
#: Rows of a chunk, which is kept or passed over as a whole for each anchor.
CHUNK = 512
#: Candidates that a task gathers before it keeps only the best.
PENDING = 1 << 18
LEAST, MOST = -(1 << 62), 1 << 62


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): vectors as integers floor(scale * x), of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def matrix(column: pa.ListArray, dim: int, dtype: str) -> np.ndarray:
    """Rows of a list column, short ones ended by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(-1, dim).astype(dtype)
    out = np.zeros((len(sizes), dim), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Space:
    """What all tasks know: the dimension, the largest squared norm, and the pivots in the augmented space."""

    dim: int
    most: float
    pivots: np.ndarray

    @property
    def dtype(self) -> str:
        """The narrowest type in which inner products of rows are exact."""
        return "f4" if self.most < 1 << 24 else "f8" if self.most < 1 << 53 else "i8"

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances of rows, or of queries, to the pivots."""
        x = x.astype("f8")
        square = (x * x).sum(1)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - square, 0))
        p, extra = self.pivots[:, :-1], self.pivots[:, -1]
        d2 = square[:, None] + more[:, None] ** 2 + (p * p).sum(1) + extra**2 - 2 * (x @ p.T + more[:, None] * extra)
        return np.sqrt(np.maximum(d2, 0))


def choose_pivots(x: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample that lie far from each other, augmented; the first is the one of least norm."""
    full = np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]).astype("f8")
    if not len(full):
        return np.zeros((1, full.shape[1]))
    chosen = [int((x * x).sum(1).argmin())]
    far = ((full - full[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(full)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
    return full[chosen]


def pivot_table(points: DataFrame) -> tuple[DataFrame, Space, pa.Table]:
    """The stored table (uid, vec_id, label, v, far, cell, ring), its space, and the sample's rows of it.

    ``far`` are the distances to the pivots, ``cell`` the nearest pivot and ``ring`` the distance
    to it; ``uid`` numbers the rows.
    """
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, dim, most = points.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    dim, most = int(dim or 0), float(most or 0)
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).select("v").toArrow().combine_chunks()
    held = matrix(sample.column(0).chunk(0), dim, "f8") if n else np.zeros((0, dim))
    space = Space(dim, most, choose_pivots(held, most))
    shared = points.sparkSession.sparkContext.broadcast(space)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = shared.value.distances(matrix(batch.column(3), shared.value.dim, "f8"))
            cell = d.argmin(1)
            far = pa.FixedSizeListArray.from_arrays(pa.array(d.astype("f4").ravel()), d.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, far, pa.array(cell.astype("i4")), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "far", "cell", "ring"])

    rows = points.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v")
    rows = rows.mapInArrow(measure, "uid long, vec_id long, label long, v array<long>, far array<float>, cell int, ring double")
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = stored(rows.repartitionByRange(parts, "cell", "ring", "uid").sortWithinPartitions("cell", "ring", "uid"))
    seeds = table.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).select("uid", "vec_id", "label", "v").toArrow()
    return table, space, seeds


class Queries:
    """A block of anchors with their ranges of scores, and the best rows found so far in each range.

    ``lo`` and ``hi`` bound the ranges (anchor, slot), inclusive; a row counts if its label is the
    anchor's (``same``) or is not, and if it is not the anchor itself.
    """

    def __init__(self, uid: np.ndarray, label: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool, space: Space):
        self.uid, self.label, self.x, self.lo, self.hi, self.k, self.same, self.space = uid, label, x.astype(space.dtype), lo, hi, k, same, space
        self.far = space.distances(x, query=True)
        self.square = (x.astype("f8") ** 2).sum(1)
        self.begin()

    def begin(self) -> None:
        """Forget what was found, but for the bounds in ``lo``."""
        self.low, self.low_id = self.lo.copy(), np.full(self.lo.shape, np.iinfo(np.int64).max)
        self.kept = [np.empty(0, np.int64) for _ in range(4)]  # anchor, slot, score, vec_id
        self.waiting: list[list[np.ndarray]] = []
        self.n_waiting = self.scored = 0
        self._bound()

    def _bound(self) -> None:
        """The range of scores, and of distances with some slack, in which each anchor still looks."""
        live = self.low <= self.hi
        self.floor = np.where(live, self.low, MOST).min(1)
        self.ceiling = np.where(live, self.hi, LEAST).max(1)
        slack = 1e-5 * np.sqrt(max(self.space.most, 1))
        d2 = lambda s: self.square + self.space.most - 2 * s.astype("f8")
        self.near = np.sqrt(np.maximum(d2(self.ceiling), 0)) - slack
        self.reach = np.sqrt(np.maximum(d2(self.floor), 0)) + slack
        self.live = live.any(1)
        self.ends = self.floor.astype(self.space.dtype)[:, None], self.ceiling.astype(self.space.dtype)[:, None]

    def survivors(self, far: np.ndarray, cell: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Anchors whose bracket on a chunk meets their range, and the run of rows that is left to them."""
        least, most = far.min(0), far.max(0)
        apart = np.maximum(self.far - most, least - self.far).max(1)
        beyond = (self.far + most).min(1)
        who = np.flatnonzero(self.live & (apart <= self.reach) & (beyond >= self.near))
        if not len(who) or cell[0] != cell[-1]:
            return who, 0, len(ring)
        own = self.far[who, cell[0]]
        return who, int(np.searchsorted(ring, (own - self.reach[who]).min(), "left")), int(np.searchsorted(ring, (own + self.reach[who]).max(), "right"))

    def add(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray, who: np.ndarray) -> None:
        """Score rows exactly against the anchors ``who`` and note those in their ranges."""
        if not len(who) or not len(x):
            return
        self.scored += len(who) * len(x)
        score = (self.x if len(who) == len(self.x) else self.x[who]) @ x.astype(self.space.dtype).T
        a, row = np.nonzero((score >= self.ends[0][who]) & (score <= self.ends[1][who]))
        s, a = score[a, row].astype(np.int64), who[a]
        ok = ((label[row] == self.label[a]) == self.same) & (uid[row] != self.uid[a])
        a, row, s = a[ok], row[ok], s[ok]
        name = vec_id[row]
        for j in range(self.lo.shape[1]):
            low = self.low[a, j]
            ok = (s <= self.hi[a, j]) & ((s > low) | (s == low) & (name <= self.low_id[a, j]))
            if ok.any():
                self.waiting.append([a[ok], np.full(ok.sum(), j), s[ok], name[ok]])
                self.n_waiting += int(ok.sum())
        if self.n_waiting > PENDING:
            self.settle()

    def settle(self) -> None:
        """Keep the best ``k`` rows of each range and look for no worse ones from now on."""
        if not self.waiting:
            return
        a, j, s, name = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((name, -s, j, a))
        a, j, s, name = a[order], j[order], s[order], name[order]
        group = a * self.lo.shape[1] + j
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        last = rank == self.k - 1
        self.low[a[last], j[last]], self.low_id[a[last], j[last]] = s[last], name[last]
        self.kept = [c[rank < self.k] for c in (a, j, s, name)]
        self.waiting, self.n_waiting = [], 0
        self._bound()

    def seed(self, sample: pa.Table) -> None:
        """Raise ``lo`` to what the sample's rows give, a bound that the whole table can only exceed."""
        x = matrix(sample.column("v").combine_chunks(), self.space.dim, self.space.dtype)
        uid, vec_id, label = (sample.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        for part in np.array_split(np.arange(len(self.x)), max(1, len(self.x) // 1024)):
            self.add(uid, vec_id, label, x, part)
        self.settle()
        self.lo = self.low
        self.begin()


def scan(table: DataFrame, queries: Queries) -> DataFrame:
    """(query, slot, rank, vec_id, score): the best rows of each range of the block of queries, by score and vec_id."""
    shared = table.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        q.begin()
        for batch in batches:
            uid, vec_id, label, cell, ring = (batch.column(k).to_numpy() for k in (0, 1, 2, 5, 6))
            x, far = matrix(batch.column(3), q.space.dim, q.space.dtype), matrix(batch.column(4), len(q.space.pivots), "f4")
            edges = np.union1d(np.arange(0, len(uid), CHUNK), np.flatnonzero(np.diff(cell)) + 1)  # a chunk has one cell
            for c, d in zip(edges, [*edges[1:], len(uid)], strict=True):
                who, a, b = q.survivors(far[c:d], cell[c:d], ring[c:d])
                q.add(uid[c + a : c + b], vec_id[c + a : c + b], label[c + a : c + b], x[c + a : c + b], who)
            q.settle()
        if len(q.kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q.uid[q.kept[0]]), *map(pa.array, q.kept[1:])], names=["query", "slot", "score", "vec_id"])

    found = table.select("uid", "vec_id", "label", "v", "far", "cell", "ring").mapInArrow(run, "query long, slot long, score long, vec_id long")
    best = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= queries.k)


def hard_negatives(points: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of quantised ``points``.

    Anchors are the rows whose vec_id is divisible by ``every``; a negative's score lies between
    ``low`` and ``high`` hundredths of the positive's, both inclusive.
    """
    spark = points.sparkSession
    table, space, sample = pivot_table(points)
    anchors = table.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-anchors.count() // BLOCK))
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "vec_id", "label", "v").toArrow()
        n = len(block)
        if not n:
            continue
        uid, vec_id, label = (block.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        x = matrix(block.column("v").combine_chunks(), space.dim, space.dtype)
        order = np.argsort(uid)
        uid, vec_id, label, x = uid[order], vec_id[order], label[order], x[order]
        first = Queries(uid, label, x, np.full((n, 1), LEAST), np.full((n, 1), MOST), positives, True, space)
        first.seed(sample)
        near = scan(table, first).toArrow()  # at most BLOCK * positives rows
        at, slot = np.searchsorted(uid, near.column("query").to_numpy()), near.column("rank").to_numpy() - 1
        score, name, have = (np.zeros((n, positives), t) for t in (np.int64, np.int64, bool))
        score[at, slot], name[at, slot], have[at, slot] = near.column("score").to_numpy(), near.column("vec_id").to_numpy(), True
        lo, hi = -(-low * score // 100), high * score // 100
        lo, hi = np.where(have & (lo <= hi), lo, MOST), np.where(have & (lo <= hi), hi, LEAST)
        then = Queries(uid, label, x, lo, hi, negatives, False, space)
        then.seed(sample)
        pairs = pa.table({"query": uid[np.repeat(np.arange(n), positives)], "slot": np.tile(np.arange(positives), n), "anchor_id": vec_id[np.repeat(np.arange(n), positives)], "positive_id": name.ravel(), "positive_score": score.ravel()})
        named = F.broadcast(spark.createDataFrame(pairs.filter(pa.array(have.ravel()))))  # at most BLOCK * positives rows
        rows = scan(table, then).join(named, ["query", "slot"])
        rows.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/block={b}")
        out = spark.read.schema(schema).parquet(path).select(*out.columns)
    return out


def shifted(df: DataFrame) -> DataFrame:
    """``df`` where every seventh vec_id bears the next of ten labels, as mislabelled rows do."""
    return df.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Ten negatives of each of five positives of every hundredth vector, against all vectors."""
    return hard_negatives(quantised(shifted(read_table(spark, sf_dir, "embeddings"))))


OP11_SQL = """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
g AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT g.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, other) AS k
 FROM g JOIN s ON g.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10"""
