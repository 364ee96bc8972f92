"""Density clusters and radius components as relations, over cells instead of pairs of points.

Space is cut into cells whose points are all within the radius of each other: the points of a cell are one node.
Two cells are linked if some points of both are near.  Most are by their first points; pairs of points are looked at
between cells that are still in different components then, and around the points of cells too thin to be dense by
themselves, of which a cell has fewer than ``min_samples``.  So rows grow with the points, not with their pairs.

Defined results: points with a coordinate that is null or not finite are alone; coordinates beyond 2^50 radii meet only
equal ones; repeated points count one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.operators.graph import connected_components, stored

CELL = ["_cx", "_cy", "_cz"]
#: Neighbours that a cell's points can reach, and one of each two of them.
AROUND = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) != (0, 0, 0)]
AHEAD = [s for s in AROUND if s > (0, 0, 0)]


def _placed(points: DataFrame, keys: list[str], hit: str, radius: Column) -> DataFrame:
    """(keys, hit, x, y, z, node, r, cell): points with a number and their cell, null if not finite."""
    edge = F.col("r") / math.sqrt(3) * (1 - 1e-6)
    size = [F.abs(F.col(c).cast("double")) for c in "xyz"]
    finite = (size[0] < float("inf")) & (size[1] < float("inf")) & (size[2] < float("inf"))
    rows = points.select(*keys, F.col(hit).alias("hit"), *[F.col(c).cast("double").alias(c) for c in "xyz"], radius.cast("double").alias("r"))
    place = lambda c: F.when(finite, F.when(F.abs(F.col(c)) < F.col("r") * 2.0**50, F.floor(F.col(c) / edge)).otherwise(F.shiftright(F.xxhash64(c), 4)))
    return rows.withColumns({f"_c{c}": place(c) for c in "xyz"}).withColumn("node", F.monotonically_increasing_id())


def _cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, cell, cell_id, n, first point, box) of the cells of points."""
    box = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    made = points.where("_cx is not null").groupBy(*keys, "r", *CELL).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("cell"), *[F.first(c).alias(c) for c in "xyz"], *box)
    return stored(made)


def _moved(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """``df`` copied to cells around its own."""
    at = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", s, strict=True)]) for s in steps])
    out = df.withColumn("_s", F.explode(at))
    return out.withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_s.{c}") for c in "xyz"}).drop("_s")


def _gap(lo: str, hi: str, rlo: str, rhi: str) -> Column:
    """Distance of two boxes."""
    d = [F.greatest(F.col(f"{rlo}{c}") - F.col(f"{hi}{c}"), F.col(f"{lo}{c}") - F.col(f"{rhi}{c}"), F.lit(0.0)) for c in "xyz"]
    return F.sqrt(geom.dot(d, d))


def _linked_cells(points: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(cell, root): components of cells (of ``points``), those with near points linked; cells without links are left out."""
    mine = ["cell", *[f"{p}{c}" for p in ("", "lo", "hi") for c in "xyz"]]
    left = _moved(cells.select(*keys, "r", *CELL, *mine), AHEAD)
    right = cells.select(*keys, *CELL, *[F.col(c).alias(f"r{c}") for c in mine])
    near = left.join(right, [*keys, *CELL]).where(_gap("lo", "hi", "rlo", "rhi") <= F.col("r") * (1 + 1e-9))
    near = stored(near.select(F.col("cell").alias("a"), F.col("rcell").alias("b"), "r", (geom.distance(geom.vec(), geom.vec("r")) <= F.col("r")).alias("sure")))
    roots = connected_components(near.where("sure").select("a", "b"))
    of = lambda s: roots.select(F.col("node").alias(s), F.col("component").alias(f"_{s}"))
    apart = near.where("not sure").join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({f"_{s}": F.coalesce(f"_{s}", s) for s in "ab"})
    apart = stored(apart.where("_a <> _b").select("a", "b", "r", "_a", "_b"))
    if apart.isEmpty():
        return roots.select(F.col("node").alias("cell"), F.col("component").alias("root"))
    at = points.select("cell", "x", "y", "z")
    met = apart.join(at.withColumnRenamed("cell", "a"), "a").join(at.select(F.col("cell").alias("b"), *[F.col(c).alias(f"r{c}") for c in "xyz"]), "b")
    more = met.where(geom.distance(geom.vec(), geom.vec("r")) <= F.col("r")).select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    joined = connected_components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return joined.select(F.col("node").alias("cell"), F.col("component").alias("root"))


def _around(thin: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``thin`` beside all ``others`` (rx, ry, rz) within their radius in other cells."""
    return _moved(thin, AROUND).join(others, [*keys, *CELL]).where(geom.distance(geom.vec(), geom.vec("r")) <= F.col("r"))


def clusters(points: DataFrame, radius: Column, min_samples: int, keys: list[str], hit: str = "hit_id", alone: bool = True) -> DataFrame:
    """(keys, hit, cluster) as ``dbscan``, where every row has its own ``radius``, the same for equal keys.

    Points that are not finite are clusters of their own if one sample is enough and ``alone``.
    """
    rows = stored(_placed(points, keys, hit, radius))
    cells = _cells(rows, keys)
    rows = rows.join(cells.select(*keys, *CELL, "cell", "n"), [*keys, *CELL], "left")
    rows = stored(rows)
    real = rows.where("cell is not null")
    thin = real.where(F.col("n") < min_samples)
    at = [F.col(c).alias(f"r{c}") for c in "xyz"]
    some = _around(thin.select(*keys, *CELL, "node", "n", "r", "x", "y", "z"), real.select(*keys, *CELL, *at), keys)
    dense = some.groupBy("node", "n").agg(F.count(F.lit(1)).alias("more")).where(F.col("more") + F.col("n") >= min_samples).select("node")
    lone = rows.where("cell is null").select(*keys, "hit", "node", F.col("node").alias("root")) if alone and min_samples <= 1 else None

    cores = real.where(F.col("n") >= min_samples)
    if min_samples > 1:
        cores = cores.unionByName(thin.join(dense, "node", "left_semi").select(*cores.columns))
    cores = stored(cores.drop("cell", "n"))
    kept = _cells(cores, keys)
    inside = stored(cores.join(kept.select(*keys, *CELL, "cell"), [*keys, *CELL]))
    roots = _linked_cells(inside, kept, keys)
    seeds = inside.join(roots, "cell", "left").select(*keys, "hit", "node", F.coalesce("root", "cell").alias("root"))
    if lone is not None:
        seeds = seeds.unionByName(lone)
    seeds = stored(seeds)
    first = seeds.groupBy(*keys, "root").agg(F.min("hit").alias("least"))
    numbers = first.withColumn("cluster", (F.row_number().over(Window.partitionBy(*keys).orderBy("least")) - 1).cast("long")).select("root", "cluster")
    core_labels = stored(seeds.select("node", "root").join(numbers, "root").select("node", "cluster"))
    edge = thin.join(core_labels, "node", "left_anti")
    named = inside.select(*keys, *CELL, "node", *at).join(core_labels, "node").drop("node")
    # A border point's own cell may hold core points, too.
    own = edge.select(*keys, *CELL, "node").join(named, [*keys, *CELL]).select("node", "cluster")
    border = _around(edge.select(*keys, *CELL, "node", "r", "x", "y", "z"), named, keys).select("node", "cluster").unionByName(own)
    labels = core_labels.unionByName(border.groupBy("node").agg(F.min("cluster").alias("cluster")))
    return rows.select(*keys, "hit", "node").join(labels, "node", "left").select(*keys, F.col("hit").alias(hit), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def dbscan(points: DataFrame, eps: float, min_samples: int, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, hit, cluster): clusters numbered from 0 by their least core point, noise -1.

    A point is core if ``min_samples`` points (itself too) lie within ``eps``; clusters are the
    components of cores; a border point joins the lowest-numbered cluster among its cores.
    """
    return clusters(points, F.lit(float(eps)), min_samples, keys, hit)


def radius_components(points: DataFrame, radius: float, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, hit, component): components of the radius graph, by size from the largest, then first point."""
    rows = stored(_placed(points, keys, hit, F.lit(float(radius))))
    cells = _cells(rows, keys)
    inside = stored(rows.join(cells.select(*keys, *CELL, "cell"), [*keys, *CELL], "left"))
    roots = _linked_cells(inside.where("cell is not null"), cells, keys)
    named = inside.join(roots, "cell", "left").select(*keys, "hit", "node", F.coalesce("root", "cell", "node").alias("root"))
    named = stored(named)
    sizes = named.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("size"), F.min("hit").alias("least"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "least")
    numbers = sizes.withColumn("component", F.row_number().over(order) - 1).select("root", "size", "component")
    return named.join(numbers, "root").select(*keys, F.col("hit").alias(hit), "component", "size")
