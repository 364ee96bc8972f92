"""Relational stages of the clustering chain: absorption, fragments, line choice, vertex pairs, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import ends, line_moments, pinned
from cloudloom.operators.spatial import eps_join


def fragment_targets(hits: DataFrame, keys: list[str], most: int = 10, radius: float = 3.0, only_blobs_from: int | None = None) -> DataFrame:
    """(keys, label, target, dist): the label of the nearest hit of a larger label, for small labels.

    ``only_blobs_from`` restricts targets to labels from there on; ties go to the least hit_id.
    """
    on = [*keys, "label"]
    sizes = hits.where("label >= 0").groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    sized = hits.join(sizes, on)
    small = sized.where(F.col("_n") <= most).select(*on, F.col("hit_id").alias("i"), "x", "y", "z")
    large = sized.where(F.col("_n") > most)
    if only_blobs_from is not None:
        large = large.where(F.col("label") >= only_blobs_from)
    large = large.select(*keys, F.col("label").alias("target"), F.col("hit_id").alias("j"), "x", "y", "z")
    met = eps_join(small, large, radius, keys)
    best = met.groupBy(*on).agg(F.min(F.struct("dist", "j", "target")).alias("b"))
    return best.select(*on, F.col("b.target").alias("target"), F.col("b.dist").alias("dist"))


def absorb_fragments(hits: DataFrame, keys: list[str], most: int = 10, radius: float = 3.0, only_blobs_from: int | None = None) -> DataFrame:
    """``hits`` with small labels moved; their targets never move, so no components are needed."""
    moves = fragment_targets(hits, keys, most, radius, only_blobs_from).select(*keys, "label", "target")
    return hits.join(moves, [*keys, "label"], "left").withColumn("label", F.coalesce("target", "label")).select(*hits.columns)


def track_models(tracks: DataFrame, keys: list[str], lam: float = 1.2, scale: float = 1.5, base: float = 1.2, margin: float = 4.0) -> DataFrame:
    """One cylinder a (track, cell) with at least two hits."""
    m = line_moments(tracks, [*keys, "label", "tpc"]).where("n >= 2")
    radius = F.greatest(F.lit(max(lam, base)), F.col("q90")) * scale
    return pinned(pinned(m, {"radius": radius}), {"margin": F.greatest(F.lit(margin), F.col("radius"))})


def absorb_into_tracks(noise: DataFrame, tracks: DataFrame, keys: list[str], **model) -> DataFrame:
    """(keys, hit_id, track, score): the cylinder of its cell that a noise hit is relatively nearest to.

    Equal scores go to the least track.  A cell has few tracks, so the join is on the cell.
    """
    m = track_models(tracks, keys, **model).select(*keys, "tpc", F.col("label").alias("track"), "cx", "cy", "cz", "dx", "dy", "dz", "tmin", "tmax", "radius", "margin")
    met = noise.join(m, [*keys, "tpc"])
    t = geom.dot(geom.sub(geom.vec(), geom.vec("c")), geom.vec("d"))
    perp = geom.line_distance(geom.vec(), geom.vec("c"), geom.vec("d"))
    ok = pinned(met, {"_t": t, "_p": perp}).where((F.col("_p") <= F.col("radius")) & (F.col("_t") >= F.col("tmin") - F.col("margin")) & (F.col("_t") <= F.col("tmax") + F.col("margin")))
    best = ok.withColumn("score", F.col("_p") / F.col("radius")).groupBy(*keys, "hit_id").agg(F.min(F.struct("score", "track")).alias("b"))
    return best.select(*keys, "hit_id", F.col("b.track").alias("track"), F.col("b.score").alias("score"))


def absorb_into_showers(noise: DataFrame, showers: DataFrame, keys: list[str], least: int = 12, floor: float = 2.0, widen: float = 1.1, most: float = 2.2, share: float = 0.3) -> DataFrame:
    """(keys, hit_id, target, score): noise in the ellipsoid of its nearest shower, nearest first.

    Axes are floored at ``floor``; a shower takes at most ``share`` of its size, at least one, and
    a hit over the cap is not offered to the runner-up.
    """
    # The second axis comes from the same covariance; the third is their cross product.
    m = line_moments(showers, [*keys, "label"]).where(F.col("n") >= least)
    grow = F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    sigma = [F.greatest(F.sqrt(F.col(f"l{k}") * grow), F.lit(floor)) * widen for k in (1, 2, 3)]
    m = pinned(second_axis(m), {f"s{k + 1}": s for k, s in enumerate(sigma)})
    cols = ["n", "cx", "cy", "cz", "dx", "dy", "dz", "px", "py", "pz", "s1", "s2", "s3"]
    met = noise.select(*keys, "hit_id", "x", "y", "z").join(m.select(*keys, F.col("label").alias("target"), *cols), keys)
    r = geom.sub(geom.vec(), geom.vec("c"))
    third = geom.cross(geom.vec("d"), geom.vec("p"))
    score = F.sqrt((geom.dot(r, geom.vec("d")) / F.col("s1")) ** 2 + (geom.dot(r, geom.vec("p")) / F.col("s2")) ** 2 + (geom.dot(r, third) / F.col("s3")) ** 2)
    near = pinned(met, {"score": score}).where(F.col("score") <= most).groupBy(*keys, "hit_id").agg(F.min(F.struct("score", "target", "n")).alias("b"))
    near = near.select(*keys, "hit_id", "b.*")
    place = F.row_number().over(Window.partitionBy(*keys, "target").orderBy("score", "hit_id"))
    cap = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return near.withColumn("_k", place).where(F.col("_k") <= cap).select(*keys, "hit_id", "target", "score")


def second_axis(lines: DataFrame) -> DataFrame:
    """Add the second principal axis px, py, pz of ``line_moments`` rows."""
    c = {k: F.col(f"c_{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    rows = [(c["xx"] - F.col("l2"), c["xy"], c["xz"]), (c["xy"], c["yy"] - F.col("l2"), c["yz"]), (c["xz"], c["yz"], c["zz"] - F.col("l2"))]
    crosses = [geom.cross(rows[0], rows[1]), geom.cross(rows[0], rows[2]), geom.cross(rows[1], rows[2])]
    out = pinned(lines, {f"_n{k}": geom.dot(v, v) for k, v in enumerate(crosses)})
    n0, n1, n2 = (F.col(f"_n{k}") for k in range(3))
    pick = [F.when((n0 >= n1) & (n0 >= n2), crosses[0][k]).when(n1 >= n2, crosses[1][k]).otherwise(crosses[2][k]) for k in range(3)]
    out = pinned(out, {f"_{a}": v for a, v in zip("xyz", pick, strict=True)})
    raw, d = geom.vec("_"), geom.vec("d")
    flat = geom.sub(raw, geom.scale(d, geom.dot(raw, d)))
    side = geom.cross(d, tuple(F.when(F.abs(d[0]) < 0.9, F.lit(v)).otherwise(F.lit(w)) for v, w in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0))))
    usable = geom.dot(flat, flat) > 1e-18
    best = geom.unit(tuple(F.when(usable, a).otherwise(b) for a, b in zip(flat, side, strict=True)))
    return pinned(out, {f"p{a}": v for a, v in zip("xyz", best, strict=True)}).drop("_n0", "_n1", "_n2", "_x", "_y", "_z")


def select_lines(points: DataFrame, lines: DataFrame, keys: list[str], rss_limit: float) -> DataFrame:
    """(keys, k, rss, bic, chosen): fit of the k largest lines, for every k, and the k to keep.

    Chosen is the first k with rss within the limit, else the k of least BIC, else of least rss.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "label")
    ranked = lines.withColumn("rank", F.row_number().over(order)).select(*keys, "rank", "cx", "cy", "cz", "dx", "dy", "dz")
    d = geom.line_distance(geom.vec(), geom.vec("c"), geom.vec("d"))
    met = points.select(*keys, "hit_id", "x", "y", "z").join(ranked, keys).withColumn("d2", d * d)
    best = F.min("d2").over(Window.partitionBy(*keys, "hit_id").orderBy("rank"))
    curve = met.withColumn("d2", best).groupBy(*keys, F.col("rank").alias("k")).agg(F.sum("d2").alias("rss"), F.count(F.lit(1)).alias("n"))
    curve = curve.withColumn("bic", F.col("n") * F.log(F.greatest(F.col("rss"), F.lit(1e-12)) / F.col("n")) + 5 * F.col("k") * F.log("n"))
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("rss") <= rss_limit, F.col("k"))).over(w)
    least = F.min(F.struct("bic", "k")).over(w)["k"]
    return curve.withColumn("chosen", F.col("k") == F.coalesce(first, least))


def end_anchors(hits: DataFrame, keys: list[str], count: int = 3) -> DataFrame:
    """(keys, label, end, x, y, z): mean of the ``count`` most extreme hits at both ends of each label."""
    on = [*keys, "label"]
    m = line_moments(hits, on).select(*on, "cx", "cy", "cz", "dx", "dy", "dz")
    t = hits.join(m, on).withColumn("t", geom.dot(geom.sub(geom.vec(), geom.vec("c")), geom.vec("d")))
    lo, hi = (F.row_number().over(Window.partitionBy(*on).orderBy(o, "hit_id")) for o in (F.col("t"), F.desc("t")))
    both = t.withColumns({"_lo": lo, "_hi": hi})
    parts = [both.where(F.col(c) <= count).groupBy(*on).agg(*[F.avg(a).alias(a) for a in "xyz"]).withColumn("end", F.lit(e)) for e, c in ((0, "_lo"), (1, "_hi"))]
    return parts[0].unionByName(parts[1])


def vertex_merge_pairs(hits: DataFrame, keys: list[str], least: int = 15, length: float = 4.0, reach: float = 4.0, line: float = 2.5, lo: float = 15.0, hi: float = 165.0, core: float = 3.0) -> DataFrame:
    """(keys, a, b, dist): track ends that meet at an angle and do not cross each other's middle."""
    on = [*keys, "label"]
    m = ends(line_moments(hits, on).where((F.col("n") >= least) & (F.col("length") >= length)))
    tips = []
    for e, (tip, out) in enumerate((("a", -1.0), ("b", 1.0))):
        tips.append(m.select(*on, F.lit(e).alias("end"), *[F.col(f"{tip}{c}").alias(c) for c in "xyz"], *[(F.col(f"d{c}") * -out).alias(f"in{c}") for c in "xyz"], *[F.col(f"c{c}") for c in "xyz"], *[F.col(f"d{c}") for c in "xyz"]))
    tip = tips[0].unionByName(tips[1])
    cols = ["label", "end", "inx", "iny", "inz", "cx", "cy", "cz", "dx", "dy", "dz"]
    p = tip.withColumnsRenamed({c: f"l_{c}" for c in cols})
    q = tip.withColumnsRenamed({c: f"r_{c}" for c in cols})
    met = eps_join(p, q, reach, keys).where("l_label < r_label")
    mid = tuple((F.col(c) + F.col(f"r{c}")) / 2 for c in "xyz")
    near = [geom.line_distance(mid, geom.vec(f"{s}_c"), geom.vec(f"{s}_d")) <= line for s in "lr"]
    turn = F.degrees(F.acos(geom.clip(geom.dot(geom.vec("l_in"), geom.vec("r_in")), -1, 1)))
    ok = met.where(near[0] & near[1] & (turn >= lo) & (turn <= hi))
    w = Window.partitionBy(*keys, "l_label", "r_label").orderBy("dist", "l_end", "r_end")
    best = ok.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, F.col("l_label").alias("a"), F.col("r_label").alias("b"), "dist", *[((F.col(c) + F.col(f"r{c}")) / 2).alias(c) for c in "xyz"])
    # Veto: the meeting point lies in the middle (30 to 70 %) of either track.
    t = (geom.dot(geom.sub(geom.vec(), geom.vec("c")), geom.vec("d")) - F.col("tmin")) / F.greatest(F.col("length"), F.lit(1e-9))
    inner = hits.join(m.select(*on, "cx", "cy", "cz", "dx", "dy", "dz", "tmin", "length"), on).where((t >= 0.3) & (t <= 0.7)).select(*keys, F.col("label").alias("core_label"), "x", "y", "z")
    hit = eps_join(best.select(*keys, "a", "b", "x", "y", "z"), inner, core, keys).where("core_label = a or core_label = b").select(*keys, "a", "b").distinct()
    return best.join(hit, [*keys, "a", "b"], "left_anti").select(*keys, "a", "b", "dist")


def apply_merges(hits: DataFrame, pairs: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``hits`` with merged labels: components of the pairs keep their least label; larger ones than ``most`` stay apart."""
    from cloudloom.operators.graph import connected_components, group_of_limited_size

    comps = connected_components(pairs.select(F.struct(*keys, F.col("a").alias("label")).alias("a"), F.struct(*keys, F.col("b").alias("label")).alias("b")))
    if most:
        comps = group_of_limited_size(comps, "component", most)
    new = comps.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.label").alias("label"), F.col("component.label").alias("_to"))
    return hits.join(new, [*keys, "label"], "left").withColumn("label", F.coalesce("_to", "label")).select(*hits.columns)
