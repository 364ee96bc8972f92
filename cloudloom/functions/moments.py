"""Line moments of groups of points: closed-form 3x3 eigen decomposition over plain aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geom

COV = {"xx": "xx", "xy": "xy", "xz": "xz", "yy": "yy", "yz": "yz", "zz": "zz"}


def aggregates() -> list[Column]:
    """Count, energy, centroid and population covariances of the columns x, y, z, e."""
    pairs = [F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return [F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], *pairs]


def eigenvalues() -> tuple[Column, Column, Column]:
    """Eigenvalues of the covariance columns, largest first (trigonometric form)."""
    xx, xy, xz, yy, yz, zz = (F.col(f"c_{k}") for k in COV)
    q = (xx + yy + zz) / 3
    p2 = (xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy**2 + xz**2 + yz**2)
    p = F.sqrt(p2 / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.when(p > 1e-15, geom.clip(det / (2 * p**3), -1, 1)).otherwise(1.0)
    phi = F.acos(r) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return first, 3 * q - first - last, last


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row.

    Expressions on top of expressions would otherwise be copied into each other (and into every
    filter above) until the plan no longer fits; they are not copied through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def with_axes(df: DataFrame) -> DataFrame:
    """Add l1, l2, l3, linearity, transverse rms and the principal direction dx, dy, dz.

    The direction is the longest of the three cross products of rows of (C - l1 I), with P16's
    sign; of a group without extent it is the x axis.
    """
    l1, l2, l3 = eigenvalues()
    df = pinned(df, {"l1": F.greatest(l1, F.lit(0.0)), "l2": F.greatest(l2, F.lit(0.0)), "l3": F.greatest(l3, F.lit(0.0))})
    total = F.col("l1") + F.col("l2") + F.col("l3")
    df = pinned(df, {"linearity": F.col("l1") / F.greatest(total, F.lit(1e-12)), "rms": F.sqrt(F.col("l2") + F.col("l3"))})
    c = {k: F.col(f"c_{k}") for k in COV}
    rows = [(c["xx"] - F.col("l1"), c["xy"], c["xz"]), (c["xy"], c["yy"] - F.col("l1"), c["yz"]), (c["xz"], c["yz"], c["zz"] - F.col("l1"))]
    crosses = [geom.cross(rows[0], rows[1]), geom.cross(rows[0], rows[2]), geom.cross(rows[1], rows[2])]
    df = pinned(df, {f"_n{k}": geom.dot(v, v) for k, v in enumerate(crosses)})
    n0, n1, n2 = (F.col(f"_n{k}") for k in range(3))
    pick = [F.when((n0 >= n1) & (n0 >= n2), crosses[0][k]).when(n1 >= n2, crosses[1][k]).otherwise(crosses[2][k]) for k in range(3)]
    big = F.greatest(n0, n1, n2)
    df = pinned(df, {f"_{a}": F.when(big > 1e-24, v / F.sqrt(big)).otherwise(1.0 if a == "x" else 0.0) for a, v in zip("xyz", pick, strict=True)})
    signed = geom.fixed_sign(geom.vec("_"))
    return pinned(df, {f"d{a}": v for a, v in zip("xyz", signed, strict=True)}).drop("_n0", "_n1", "_n2", "_x", "_y", "_z")


def line_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Moments, principal direction, extent (tmin, tmax, length) and q90 radius of each group.

    Two aggregations over the points: the second needs the first's direction, which is joined on
    the keys (both are dealt out by them).  The rms comes from the distances themselves, as that of
    points on a line would be lost in the rounding of the eigenvalues.
    """
    lines = with_axes(points.groupBy(*keys).agg(*aggregates()))
    joined = points.select(*keys, "x", "y", "z").join(lines.select(*keys, "cx", "cy", "cz", "dx", "dy", "dz"), keys)
    r = geom.sub(geom.vec(), geom.vec("c"))
    t, perp = geom.dot(r, geom.vec("d")), geom.line_distance(geom.vec(), geom.vec("c"), geom.vec("d"))
    reach = joined.withColumns({"t": t, "perp": perp}).groupBy(*keys).agg(F.min("t").alias("tmin"), F.max("t").alias("tmax"), F.percentile("perp", 0.9).alias("q90"), F.percentile("perp", 0.5).alias("q50"), F.sqrt(F.avg(F.col("perp") * F.col("perp"))).alias("rms"))
    return lines.drop("rms").join(reach.withColumn("length", F.col("tmax") - F.col("tmin")), keys)


def ends(lines: DataFrame) -> DataFrame:
    """Add the two end points ax.. and bx.. of fitted lines."""
    at = lambda t: geom.add(geom.vec("c"), geom.scale(geom.vec("d"), F.col(t)))
    a, b = at("tmin"), at("tmax")
    return lines.withColumns({f"a{k}": v for k, v in zip("xyz", a, strict=True)} | {f"b{k}": v for k, v in zip("xyz", b, strict=True)})


def local_directions(points: DataFrame, tips: DataFrame, keys: list[str], radius: float, slab: bool = False, least: int = 3, nearest: int = 6) -> DataFrame:
    """Outward direction at each tip (keys, end, tx, ty, tz, ox, oy, oz: towards the outside).

    Fitted on the group's points within ``radius`` of the tip (or, ``slab``, in z alone); where
    fewer than ``least`` lie there, on the ``nearest`` ones.
    """
    from pyspark.sql import Window

    d = geom.distance(geom.vec(), geom.vec("t"))
    near = F.abs(F.col("z") - F.col("tz")) if slab else d
    joined = points.select(*keys, "x", "y", "z", "e").join(tips, keys).withColumns({"_d": d, "_in": near <= radius})
    w = Window.partitionBy(*keys, "end")
    ranked = joined.withColumns({"_k": F.row_number().over(w.orderBy("_d", "x", "y", "z")), "_n": F.sum(F.col("_in").cast("int")).over(w)})
    used = ranked.where(F.when(F.col("_n") >= least, F.col("_in")).otherwise(F.col("_k") <= nearest))
    fit = with_axes(used.groupBy(*keys, "end").agg(*aggregates(), *[F.first(f"o{c}").alias(f"o{c}") for c in "xyz"], *[F.first(f"t{c}").alias(f"t{c}") for c in "xyz"]))
    turn = F.when(geom.dot(geom.vec("d"), geom.vec("o")) < 0, -1.0).otherwise(1.0)
    return fit.select(*keys, "end", "tx", "ty", "tz", *[(F.col(f"d{c}") * turn).alias(f"u{c}") for c in "xyz"])
