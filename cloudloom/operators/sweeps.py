"""Density clusterings at many radii: sweeps over cells, and the spanning forest of mutual reachability.

The core distance of a point is the radius at which it becomes a core point; two points are linked at a
radius if it reaches their distance and both core distances (their mutual reachability).  A least
spanning forest of the links up to the largest radius holds the clusters of every smaller one: cut its
longer edges off, and the components that stay are the clusters.  It holds all pairs within that radius;
``dbscan_sweep`` does not need them.

The forest comes from Boruvka rounds: each component takes its least edge outwards, chosen edges
merge components, edges inside one component go, and of edges between the same two only the least stays.
A round is aggregations and equi-joins; their number grows with the logarithm of the points.
Points at one place are one spot with a weight, so any number of copies costs one row.

Defined results: points with a coordinate that is null or not finite are noise and link nothing; of equal
edges the least by spot is taken; radii may repeat or come in any order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import density
from cloudloom.operators.graph import connected_components, stored
from cloudloom.operators.spatial import near_pairs


def spots(points: DataFrame, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, x, y, z, weight, least, node): the places of ``points``, with how many are there and the least of them."""
    there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    at = points.where(there[0] & there[1] & there[2]).groupBy(*keys, "x", "y", "z")
    return stored(at.agg(F.count(F.lit(1)).alias("weight"), F.min(hit).alias("least")).withColumn("node", F.monotonically_increasing_id()))


def core_distances(places: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """(node, core): the least radius within which ``min_samples`` points lie, of the spots that have one among ``pairs``."""
    weights = places.select(F.col("node").alias("j"), F.col("weight").alias("more"))
    both = pairs.select("i", "j", "dist").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    own = places.select(F.col("node").alias("i"), F.lit(0.0).alias("dist"), F.col("weight").alias("more"))
    near = both.join(weights, "j").select("i", "dist", "more").unionByName(own)
    within = F.sum("more").over(Window.partitionBy("i").orderBy("dist").rangeBetween(Window.unboundedPreceding, 0))
    return near.withColumn("n", within).where(F.col("n") >= min_samples).groupBy(F.col("i").alias("node")).agg(F.min("dist").alias("core"))


def spanning_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The edges (u, v, w) of the least spanning forest; of equal w the least (u, v) counts as less."""
    left = stored(edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    out = left.select("u", "v", "w").limit(0)
    for _ in range(max_rounds):
        if left.isEmpty():
            return out
        sides = left.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "u", "v", "a", "b").alias("edge"))
        chosen = stored(sides.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        out = out.unionByName(chosen.select("u", "v", "w"))
        to = connected_components(chosen)
        for s in "ab":
            left = left.join(to.select(F.col("node").alias(s), F.col("component").alias(f"_{s}")), s, "left").withColumn(s, F.coalesce(f"_{s}", s)).drop(f"_{s}")
        apart = left.where("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("w", "u", "v")).alias("edge"))
        left = stored(apart.select("edge.*", F.col("lo").alias("a"), F.col("hi").alias("b")))
    raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")


def reachability_forest(points: DataFrame, eps: float, min_samples: int, keys: list[str], hit: str = "hit_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spots, pairs within ``eps``, core distances, forest of mutual reachability up to ``eps``)."""
    places = spots(points, keys, hit)
    pairs = stored(near_pairs(places, eps, keys, "node").select("i", "j", "dist"))
    cores = stored(core_distances(places, pairs, min_samples))
    side = lambda s: cores.select(F.col("node").alias(s), F.col("core").alias(f"core_{s}"))
    edges = pairs.join(side("i"), "i").join(side("j"), "j")
    edges = edges.select(F.col("i").alias("u"), F.col("j").alias("v"), F.greatest("dist", "core_i", "core_j").alias("w"))
    return places, pairs, cores, stored(spanning_forest(edges))


def dbscan_sweep(points: DataFrame, radii: list[float], min_samples: int, keys: list[str], hit: str = "hit_id") -> DataFrame:
    """(keys, hit, eps, cluster) for every point and radius: what ``density.dbscan`` gives at each radius.

    All radii go through the cells of ``density`` at once, each with its own copy of a point: the forest above asks for
    all pairs within the largest radius, whose number grows with the square of crowded places.
    """
    steps = F.explode(F.array(*[F.lit(r) for r in sorted(set(map(float, radii)))]))
    copies = points.select(*keys, hit, "x", "y", "z").withColumn("eps", steps)
    return density.clusters(copies, F.col("eps"), min_samples, [*keys, "eps"], hit, alone=False).select(*keys, hit, "eps", "cluster")
