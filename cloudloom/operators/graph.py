"""Graph operators on edge tables: connected components by alternating stars."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which components are found by one task.
ONE_TASK = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a session on one machine that names none gets a temporary one; on a cluster, whose
    executors could not read it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="cloudloom-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the session's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the session's shared checkpoint folder: less disk than a checkpoint, for wide or long tables."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours, from directed pairs (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v), ascending, and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v) of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if parts:
            found = least_reachable(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is its least node.

    Alternates large-star (each node hands its larger neighbours its least one) and small-star
    (each node hands itself and its smaller neighbours its least one) until all are stars.
    Every round is aggregation plus an equi-join on the node, so that a hub is combined map-side
    and its rows can be split by the skew join; lineage is cut each round.  Self loops and nulls
    are dropped, repeated edges count once.  Up to ``ONE_TASK`` edges between longs, counted
    first, are one task's work, with the same result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    now = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if [t for _, t in now.dtypes] == ["bigint", "bigint"] and now.count() <= ONE_TASK:
        return checkpointed(_in_one_task(now))
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        if _is_forest_of_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u"), F.col("v")).distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()


def mutual_best(edges: DataFrame, keys: list[str], side_i: list[str], side_j: list[str], order: list) -> DataFrame:
    """Edges that are the first of their order at both of their sides."""
    from pyspark.sql import Window

    first = lambda side: F.row_number().over(Window.partitionBy(*keys, *side).orderBy(*order))
    return edges.withColumns({"_i": first(side_i), "_j": first(side_j)}).where("_i = 1 and _j = 1").drop("_i", "_j")


def greedy_exclusive(edges: DataFrame, keys: list[str], score: str = "score", src: str = "a", dst: str = "b") -> DataFrame:
    """Best-first acceptance where each node is used once.

    Every round takes the edges that are least at both ends (order: score, src, dst) and drops the
    edges that touch them; equal to going through all edges in order.
    """
    from pyspark.sql import Window

    order = [score, src, dst]
    left = checkpointed(edges.where(F.col(src) != F.col(dst)))
    out = left.limit(0)
    while not left.isEmpty():
        sides = left.select(*keys, F.explode(F.array(src, dst)).alias("_v"), *order)
        best = sides.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_v").orderBy(*order))).where("_k = 1")
        both = best.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
        taken = checkpointed(left.join(both, [*keys, *order], "left_semi"))
        out = out.unionByName(taken)
        used = taken.select(*keys, F.explode(F.array(src, dst)).alias("_v")).distinct()
        left = left.join(used.withColumnRenamed("_v", src), [*keys, src], "left_anti")
        left = checkpointed(left.join(used.withColumnRenamed("_v", dst), [*keys, dst], "left_anti").select(*edges.columns))
    return out


def group_of_limited_size(nodes: DataFrame, component: str, most: int) -> DataFrame:
    """Rows of components with at most ``most`` members; larger ones go as a whole."""
    sizes = nodes.groupBy(component).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).drop("_n")
    return nodes.join(sizes, component, "left_semi")
