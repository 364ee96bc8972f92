"""Vertices: density clusters of track ends whose lines converge, and the tracks that belong to them.

The median distance of lines is taken over the pairs of tracks of one end cluster, whose size the density of ends
bounds; which vertex a track belongs to is the least number among the accepted clusters that it touches, an aggregation
in place of a loop over clusters.

Defined results: an end whose coordinate is null or not finite is in no cluster; a cluster of one track's two ends is no
vertex; a track in no vertex is one of its own; equal numbers cannot occur; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import pinned
from cloudloom.operators.density import dbscan
from cloudloom.operators.graph import stored
from cloudloom.operators.segments import tips


def end_clusters(tracks: DataFrame, keys: list[str], name: str = "id", eps: float = 10.0, least: int = 3) -> DataFrame:
    """(keys, name, end, cluster): density clusters of all ends of an event's tracks; -1 for none."""
    ends = tips(tracks, keys, name).withColumn("_hit", F.col(name) * 2 + F.col("end"))
    found = dbscan(ends.select(*keys, "_hit", "x", "y", "z"), eps, least, keys, "_hit")
    return ends.select(*keys, name, "end", "_hit").join(found, [*keys, "_hit"]).drop("_hit")


def vertex_clusters(tracks: DataFrame, ends: DataFrame, keys: list[str], name: str = "id", dca: float = 4.0) -> DataFrame:
    """(keys, cluster, n_tracks, dca): end clusters of two tracks or more, whose lines' median distance is at most ``dca``."""
    on = [*keys, "cluster"]
    touched = stored(ends.where("cluster >= 0").select(*on, name).distinct())
    cols = [f"{p}{c}" for p in "cd" for c in "xyz"]
    line = lambda s: tracks.select(*keys, F.col(name).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    pairs = touched.withColumnRenamed(name, "i").join(touched.withColumnRenamed(name, "j"), on).where("i < j").join(line("i"), [*keys, "i"]).join(line("j"), [*keys, "j"])
    w = geom.sub(geom.vec("i_c"), geom.vec("j_c"))
    pairs = pinned(pairs, {"_k": geom.dot(geom.vec("i_d"), geom.vec("j_d")), "_d": geom.dot(geom.vec("i_d"), w), "_e": geom.dot(geom.vec("j_d"), w)})
    den = 1 - F.col("_k") * F.col("_k")
    flat = den < geom.TINY
    pairs = pinned(pairs, {"_s": F.when(flat, -F.col("_d")).otherwise((F.col("_k") * F.col("_e") - F.col("_d")) / den), "_t": F.when(flat, 0.0).otherwise((F.col("_e") - F.col("_k") * F.col("_d")) / den)})
    apart = geom.norm(geom.sub(geom.add(w, geom.scale(geom.vec("i_d"), F.col("_s"))), geom.scale(geom.vec("j_d"), F.col("_t"))))
    made = pinned(pairs, {"_apart": apart}).groupBy(*on).agg(F.percentile("_apart", 0.5).alias("dca")).where(F.col("dca") <= dca)
    return made.join(touched.groupBy(*on).agg(F.count(F.lit(1)).alias("n_tracks")), on).select(*on, "n_tracks", "dca")


def assign_vertices(tracks: DataFrame, keys: list[str], name: str = "id", eps: float = 10.0, least: int = 3, dca: float = 4.0, shower: int = 3) -> DataFrame:
    """(keys, name, vertex, type): accepted clusters are numbered in their order, tracks without one after them.

    A track of several takes the first; types are shower (``shower`` tracks touch it), vertex, and track for one alone.
    """
    ends = stored(end_clusters(tracks, keys, name, eps, least))
    kept = vertex_clusters(tracks, ends, keys, name, dca)
    numbered = stored(kept.withColumn("vertex", (F.row_number().over(Window.partitionBy(*keys).orderBy("cluster")) - 1).cast("long")))
    mine = ends.join(numbered, [*keys, "cluster"]).groupBy(*keys, name).agg(F.min(F.struct("vertex", "n_tracks")).alias("v"))
    counts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = tracks.select(*keys, name).join(mine, [*keys, name], "left").join(counts, keys, "left").withColumn("_own", F.col("v").isNull())
    place = F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(name)) - 1
    alone = (F.coalesce("_n", F.lit(0)) + place).cast("long")
    kind = F.when(F.col("_own"), "track").when(F.col("v.n_tracks") >= shower, "shower").otherwise("vertex")
    return rows.select(*keys, name, F.when(F.col("_own"), alone).otherwise(F.col("v.vertex")).alias("vertex"), kind.alias("type"))
