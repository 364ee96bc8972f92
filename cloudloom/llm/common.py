"""Small helpers that the training-data operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators.graph import checkpointed

#: Pieces of a summed vector, each added up by one task.
PIECES = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark has to be able to open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``.

    A reliable checkpoint survives the loss of any executor and fixes the rows and their partitions.
    """
    return checkpointed(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change other scripts)."""
    return F.translate(text, _UPPER, _UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Words of ``text`` after lower-casing A-Z: runs of digits, a-z and anything beyond ASCII."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_PATTERN), F.lit(0))


#: A word of the benchmark and license operators.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sum_vectors(
    df: DataFrame, tally: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int, dtype: str = "f8"
) -> np.ndarray:
    """Sum over all partitions of the vector that ``tally`` makes of a partition's Arrow batches.

    Vectors have a fixed ``width``.  Each partition deals its own out in ``PIECES`` pieces, equal
    pieces meet in one task, and the driver gets the sum of each: one vector's bytes, however many
    partitions there are.
    """
    size = max(1, -(-width // PIECES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.asarray(tally(batches), dtype=dtype)
        cuts = range(0, width, size)
        yield pa.RecordBatch.from_arrays([pa.array([k // size for k in cuts], pa.int32()), pa.array([zlib.compress(v[k : k + size].tobytes(), 1) for k in cuts], pa.binary())], names=["piece", "v"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(v.as_py()), dtype=dtype)
                totals[k] = totals[k] + x if k in totals else x
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in totals.values()], pa.binary())], names=["piece", "v"])

    n = min(PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = df.mapInArrow(first, "piece int, v binary").repartition(n, "piece").mapInArrow(then, "piece int, v binary").collect()
    total = np.zeros(width, dtype=dtype)
    for k, v in sums:
        total[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(bytes(v)), dtype=dtype)
    return total


def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, around which a worker gives back Arrow memory that it holds unused: workers are reused, so it would stay for all later stages."""
    pool = pa.default_memory_pool()
    pool.release_unused()
    for batch in batches:
        yield batch
        pool.release_unused()


def fold(column: str, n: int, k: int) -> Column:
    """Whether crc32 of the column as text leaves ``k`` modulo ``n`` (false for null)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n == k, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, shard: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of all labelled documents by doc_id in partitions of about ``shard``, and all class counts.

    A doc_id with several texts or labels gives one row, the least text and the greatest label.
    Texts and labels are dealt by doc_id together, so that a text is shuffled once; hand in no
    ``docs`` that are sure to have no label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {int(r[0]): int(r[1]) for r in known.groupBy("doc_id").agg(F.max("y").alias("y")).groupBy("y").count().collect()}
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("int").alias("y"))
    both = texts.unionByName(known.select("doc_id", F.lit(None).cast("string").alias("text"), "y"))
    rows = both.repartition(max(1, -(-sum(sizes.values()) // shard)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return rows.where("text is not null and y is not null"), sizes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` labelled documents of each class, and all class counts.

    Chosen are the doc_ids least in hash order, so the sample does not depend on partitions; a
    doc_id with several texts or labels gives one row, the least text and the greatest label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    sizes = {int(r[0]): int(r[1]) for r in known.groupBy("y").count().collect()}
    edges = {y: known.where(F.col("y") == y).orderBy("h").limit(per_class).agg(F.max("h")).first()[0] for y in sizes}
    pick = F.lit(False)
    for y, edge in edges.items():
        pick = pick | ((F.col("y") == y) & (F.col("h") <= F.lit(edge)))
    chosen = known.where(pick).select("doc_id", "y")  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # The least text of a doc_id that has several, so that every run learns from the same rows.
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), sizes


def slices(column: pa.Array, most_chars: int) -> Iterator[list[str]]:
    """Texts of an Arrow column (null: empty), whole, in parts of about ``most_chars``."""
    part: list[str] = []
    size = 0
    for t in column:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size > most_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    The optimizer copies an expensive expression into every filter and projection above that
    uses it; it does not copy it through the generator that makes the column here.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
