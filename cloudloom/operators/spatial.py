"""Neighbour search: radius joins on a grid, nearest and k-nearest points.

Space is cut into cells as wide as the radius; one side is copied to its 27 neighbouring cells and
the join is an equi-join on the cell, so work follows the local density and AQE can split a
crowded cell.  Cells stand in for the salt that a crowded detector cell would need otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom


def _cells(df: DataFrame, r: float, spread: bool) -> DataFrame:
    """``df`` (x, y, z) with its cell, or copied to the cell's neighbours."""
    base = {f"_c{a}": F.floor(F.col(a) / r) for a in "xyz"}
    if not spread:
        return df.withColumns(base)
    steps = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    out = df.withColumns(base).withColumn("_s", F.explode(steps))
    return out.withColumns({f"_c{a}": F.col(f"_c{a}") + F.col(f"_s.{a}") for a in "xyz"}).drop("_s")


def eps_join(left: DataFrame, right: DataFrame, r: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of points within ``r`` (inclusive) of the same keys, with their distance ``dist``.

    ``left`` and ``right`` have x, y, z, the keys, and otherwise different columns.  Columns of
    ``right``'s coordinates are called rx, ry, rz.
    """
    keys = keys or []
    cells = _cells(right, r, True).withColumnsRenamed({"x": "rx", "y": "ry", "z": "rz"})
    on = [*keys, "_cx", "_cy", "_cz"]
    met = _cells(left, r, False).join(cells, on, "inner").withColumn("dist", geom.distance(geom.vec(), geom.vec("r"))).where(F.col("dist") <= r)
    return met.drop("_cx", "_cy", "_cz")


def eps_pairs(points: DataFrame, r: float, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j within ``r``."""
    return near_pairs(points, r, keys, hit)


def near_pairs(points: DataFrame, r: float, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j within ``r``, each met once.

    A point is copied to its own cell and to the 13 that come after it, half of its neighbours.
    """
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    ahead = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", s, strict=True)]) for s in steps]))
    left = _cells(points.select(*keys, F.col(hit).alias("_a"), "x", "y", "z"), r, False).withColumn("_s", ahead)
    left = left.withColumns({f"_c{k}": F.col(f"_c{k}") + F.col(f"_s.{k}") for k in "xyz"} | {"_same": F.col("_s") == F.struct(*[F.lit(0).alias(k) for k in "xyz"])}).drop("_s")
    right = _cells(points.select(*keys, F.col(hit).alias("_b"), "x", "y", "z"), r, False).withColumnsRenamed({"x": "rx", "y": "ry", "z": "rz"})
    met = left.join(right, [*keys, "_cx", "_cy", "_cz"]).where(~F.col("_same") | (F.col("_a") < F.col("_b")))
    met = met.withColumn("dist", geom.distance(geom.vec(), geom.vec("r"))).where(F.col("dist") <= r)
    return met.select(*keys, F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), "dist")


def nearest(left: DataFrame, right: DataFrame, r: float, keys: list[str], left_id: str, order: list) -> DataFrame:
    """For each left row the nearest right row within ``r``; ``order`` settles ties after the distance."""
    met = eps_join(left, right, r, keys)
    w = Window.partitionBy(*keys, left_id).orderBy("dist", *order)
    return met.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def knn_distance(points: DataFrame, k: int, keys: list[str], start: float, hit: str = "hit_id") -> DataFrame:
    """(keys, hit, dist): distance to the k-th other point, over radii that double until all have it.

    A point of a group with k points or fewer has none (null).
    """
    from cloudloom.operators.graph import checkpointed

    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    todo = points.join(sizes, keys).select(*keys, F.col(hit).alias("i"), "x", "y", "z", "_n")
    out = todo.where(F.col("_n") <= k).select(*keys, "i", F.lit(None).cast("double").alias("dist"))
    todo, r = checkpointed(todo.where(F.col("_n") > k).drop("_n")), start
    right = points.select(*keys, F.col(hit).alias("j"), "x", "y", "z")
    while not todo.isEmpty():
        near = eps_join(todo, right, r, keys).where("i <> j")
        w = Window.partitionBy(*keys, "i").orderBy("dist", "j")
        found = checkpointed(near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == k).select(*keys, "i", "dist"))
        out = out.unionByName(found)
        todo, r = checkpointed(todo.join(found, [*keys, "i"], "left_anti")), r * 2
    return out.withColumnRenamed("i", hit)
