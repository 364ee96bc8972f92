"""Intervals on a line: coalescing, what lies outside all of them, and contact windows of tracks.

Overlapping intervals of a key become one by a running maximum of their ends; a row is outside all of
them if an anti-join with a range condition finds none, so rows are never multiplied by intervals.

Defined results: intervals that touch are one; an interval with a null bound or its ends the wrong way round
counts for none; rows with a null position lie outside; keys without intervals keep all rows; empty tables
give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import ends, line_moments, pinned
from cloudloom.operators.segments import close_segments, in_capsules
from cloudloom.operators.windows import density_bins


def coalesced(intervals: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", gap: float = 0.0) -> DataFrame:
    """(keys, lo, hi, n): disjoint intervals that cover the same as ``intervals``, closing gaps up to ``gap``; n went into each."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    good = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_new", F.when(F.col(lo) - reach <= gap, 0).otherwise(1))
    run = good.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_run")


def outside(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``rows`` whose ``at`` lies in none of their key's intervals (ends included)."""
    r, i = rows.alias("r"), intervals.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).alias("i")
    same = (F.col(f"r.{at}") >= F.col("i._lo")) & (F.col(f"r.{at}") <= F.col("i._hi"))
    for k in keys:
        same = same & (F.col(f"r.{k}") == F.col(f"i.{k}"))
    return r.join(i, same, "left_anti")


def track_cells(tracks: DataFrame, keys: list[str], least: int = 10, length: float = 8.0, base: float = 1.2) -> DataFrame:
    """One line model for each track and cell of at least ``least`` hits and ``length``: moments, ends and radius (q90, at least ``base``)."""
    m = ends(line_moments(tracks, [*keys, "label", "tpc"]))
    return m.where((F.col("n") >= least) & (F.col("length") >= length)).withColumn("radius", F.greatest(F.lit(base), F.col("q90")))


def cloud_windows(models: DataFrame, clouds: DataFrame, keys: list[str], margin: float = 3.0, least: int = 3, share: float = 0.5, widen: float = 1.5) -> DataFrame:
    """(keys, tpc, label, other, lo, hi, n, reason): the stretch of each track's cell along which a cloud's hits lie close.

    ``reason`` is null, or "long" if the stretch is more than ``share`` of the track; a cloud of fewer than
    ``least`` close hits has none.
    """
    caps = models.select(*keys, "tpc", "label", *[f"{e}{c}" for e in "ab" for c in "xyz"], (F.col("radius") * widen).alias("radius"), "tmin", "tmax")
    hits = clouds.select(*keys, "tpc", F.col("label").alias("other"), "hit_id", "x", "y", "z")
    met = in_capsules(caps, hits, [*keys, "tpc"]).where((F.col("perp") <= F.col("radius")) & (F.col("t") >= 0) & (F.col("t") <= F.col("tmax") - F.col("tmin")) & (F.col("label") != F.col("other")))
    made = met.groupBy(*keys, "tpc", "label", "other", "tmin", "tmax").agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    made = made.withColumns({"lo": F.greatest("tmin", F.col("_a") + F.col("tmin") - margin), "hi": F.least("tmax", F.col("_b") + F.col("tmin") + margin)})
    long = F.col("hi") - F.col("lo") > share * (F.col("tmax") - F.col("tmin"))
    return made.select(*keys, "tpc", "label", "other", "lo", "hi", "n", F.when(long, "long").alias("reason"))


def crossing_windows(models: DataFrame, keys: list[str], turn: float = 10.0, guard: float = 6.0, scale: float = 1.0, least: float = 3.0, most: float = 10.0) -> DataFrame:
    """(keys, tpc, label, other, lo, hi): on both tracks of a cell the stretch around the place where they cross.

    They cross if they meet within the larger of their radii (by half as much again), at an angle of at
    least ``turn`` and farther than ``guard`` from all ends.
    """
    on = [*keys, "tpc"]
    # The reach of a pair depends on both radii; the index is asked for the largest there is.
    top = models.agg(F.max("radius")).first()[0]
    if top is None:
        return models.select(*on, "label", F.col("label").alias("other"), F.col("tmin").alias("lo"), F.col("tmax").alias("hi")).limit(0)
    pairs = close_segments(models, 1.5 * scale * top + 1e-9, on, "label")
    cols = ["cx", "cy", "cz", "dx", "dy", "dz", "tmin", "tmax", "radius"]
    for s in "ij":
        pairs = pairs.join(models.select(*on, F.col("label").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols]), [*on, s])
    pairs = pairs.where(F.col("dist") <= scale * 1.5 * F.greatest("i_radius", "j_radius"))
    k = geom.dot(geom.vec("i_d"), geom.vec("j_d"))
    w = geom.sub(geom.vec("i_c"), geom.vec("j_c"))
    pairs = pinned(pairs, {"_k": k, "_d": geom.dot(geom.vec("i_d"), w), "_e": geom.dot(geom.vec("j_d"), w)})
    angle = F.acos(F.least(F.abs("_k"), F.lit(1.0)))
    pairs = pinned(pairs, {"_angle": angle}).where(F.col("_angle") >= math.radians(turn))
    den = 1 - F.col("_k") * F.col("_k")
    pairs = pinned(pairs, {"i_t": (F.col("_k") * F.col("_e") - F.col("_d")) / den, "j_t": (F.col("_e") - F.col("_k") * F.col("_d")) / den})
    clear = F.lit(True)
    for s in "ij":
        clear = clear & (F.col(f"{s}_t") - F.col(f"{s}_tmin") > guard) & (F.col(f"{s}_tmax") - F.col(f"{s}_t") > guard)
    half = geom.clip((F.col("i_radius") + F.col("j_radius")) / F.greatest(F.sin("_angle"), F.lit(1e-3)), least, most)
    both = pinned(pairs.where(clear), {"_h": half})
    sides = F.array(*[F.struct(F.col(a).alias("label"), F.col(b).alias("other"), F.greatest(F.col(f"{a}_tmin"), F.col(f"{a}_t") - F.col("_h")).alias("lo"), F.least(F.col(f"{a}_tmax"), F.col(f"{a}_t") + F.col("_h")).alias("hi")) for a, b in ("ij", "ji")])
    return both.select(*on, F.explode(sides).alias("_s")).select(*on, "_s.*")


def baselines(tracks: DataFrame, models: DataFrame, windows: DataFrame, keys: list[str], width: float = 2.0, least: int = 5, floor: float = 0.05) -> DataFrame:
    """(keys, tpc, label, n_bins, n_clean, rho0, sigma, valid): energy density of a track's cell outside all windows.

    Bins that a window touches, and one more on either side, are left out; rho0 is the median of the others and
    sigma 1.4826 times their median deviation; valid with ``least`` clean bins and a rho0 of ``floor``.
    """
    on = [*keys, "tpc", "label"]
    axis = models.select(*on, "cx", "cy", "cz", "dx", "dy", "dz", "tmin")
    along = tracks.join(axis, on).withColumn("t", geom.dot(geom.sub(geom.vec(), geom.vec("c")), geom.vec("d")))
    filled = density_bins(along.select(*on, "t", "e"), on, "t", "e", width)
    # Bins without a hit have a density too, of zero.
    size = models.select(*on, (F.col("tmax") - F.col("tmin")).alias("span"))
    full = F.greatest(F.ceil(F.col("span") / width), F.lit(1)).cast("long")
    n = F.when((full > 1) & (F.col("span") - (full - 1) * width < width / 2), full - 1).otherwise(full)
    bins = pinned(size, {"n_bins": n}).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))
    bins = bins.join(filled.select(*on, "bin", "rho"), [*on, "bin"], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    place = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("tmin")) / width).cast("long"), F.lit(0)), F.col("n_bins") - 1)
    sized = windows.join(axis.select(*on, "tmin"), on).join(bins.select(*on, "n_bins").distinct(), on)
    masks = coalesced(sized.select(*on, (place("lo") - 1).alias("lo"), (place("hi") + 1).alias("hi")), on)
    clean = outside(bins, masks, on, "bin")
    mid = clean.groupBy(*on).agg(F.percentile("rho", 0.5).alias("rho0"), F.count(F.lit(1)).alias("n_clean"))
    spread = clean.join(mid, on).groupBy(*on).agg((1.4826 * F.percentile(F.abs(F.col("rho") - F.col("rho0")), 0.5)).alias("sigma"))
    out = bins.select(*on, "n_bins").distinct().join(mid, on, "left").join(spread, on, "left").fillna(0, ["n_clean"])
    return out.withColumn("valid", F.coalesce((F.col("n_clean") >= least) & (F.col("rho0") >= floor), F.lit(False)))
