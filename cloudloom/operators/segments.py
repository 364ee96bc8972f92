"""Segments in space: an index by the grid cells they cross, near pairs, points in capsules, stitching.

A segment is sampled in steps and listed under the cells of its samples; what lies within reach of it
lies in those cells or their neighbours, so near pairs and points in capsules are equi-joins on the
cell, and work follows the length of the segments (a row for each step and cell), not the number of pairs.  A cell with very many
points is dealt over slots, in all of which its capsules stand, so no task gets it whole.

Segments have the ends ax, ay, az and bx, by, bz.

Defined results: rows with an end or a coordinate that is null or not finite meet nothing; a segment without
length is a point; ties go to the smaller ids and ends; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import local_directions, pinned
from cloudloom.operators.spatial import eps_join

#: Points of one cell beyond which it is dealt over slots.
CROWD = 50_000
#: Rows of a table of crowded cells or of levels up to which it is broadcast.
BROADCAST_ROWS = 200_000
ENDS = [f"{e}{c}" for e in "ab" for c in "xyz"]
CELL = ["_cx", "_cy", "_cz"]


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def finite(*columns: str) -> Column:
    """Whether all ``columns`` are numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return ok


def crossed_cells(step: Column, cell: Column, around: bool) -> Column:
    """Array of the grid cells of a segment's samples, ``step`` apart at most; ``around``: and of their neighbours."""
    length = geom.distance(geom.vec("a"), geom.vec("b"))
    n = F.greatest(F.ceil(length / step), F.lit(1)).cast("long")
    at = lambda k, c: F.floor((F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * k / n) / cell)
    own = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.struct(*[at(k, c).alias(f"_c{c}") for c in "xyz"])))
    if not around:
        return own
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = F.transform(own, lambda o: F.transform(steps, lambda s: F.struct(*[(o[f"_c{c}"] + s[c]).alias(f"_c{c}") for c in "xyz"])))
    return F.array_distinct(F.flatten(near))


def with_segment_distance(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``df`` with the exact distance of the segments with the prefixes ``left`` and ``right``, in steps that are each computed once."""
    p1, q1, p2, q2 = (geom.vec(f"{s}{e}") for s in (left, right) for e in "ab")
    u, v, w = geom.sub(q1, p1), geom.sub(q2, p2), geom.sub(p1, p2)
    df = pinned(df, {f"_{k}": geom.dot(*x) for k, x in {"uu": (u, u), "uv": (u, v), "vv": (v, v), "uw": (u, w), "vw": (v, w)}.items()})
    uu, uv, vv, uw, vw = (F.col(f"_{k}") for k in ("uu", "uv", "vv", "uw", "vw"))
    den = uu * vv - uv * uv
    on_point = F.when((vv <= geom.TINY) & (uu > geom.TINY), geom.clip(-uw / uu, 0, 1)).otherwise(0.0)
    df = pinned(df, {"_s0": F.when(den > geom.TINY, geom.clip((uv * vw - vv * uw) / den, 0, 1)).otherwise(on_point)})
    df = pinned(df, {"_t0": F.when(vv > geom.TINY, (uv * F.col("_s0") + vw) / vv).otherwise(0.0)})
    again = lambda top: F.when(uu > geom.TINY, geom.clip(top / uu, 0, 1)).otherwise(0.0)
    df = pinned(df, {"_t": geom.clip(F.col("_t0"), 0, 1), "_s": F.when(F.col("_t0") < 0, again(-uw)).when(F.col("_t0") > 1, again(uv - uw)).otherwise(F.col("_s0"))})
    apart = geom.distance(geom.add(p1, geom.scale(u, F.col("_s"))), geom.add(p2, geom.scale(v, F.col("_t"))))
    return pinned(df, {name: apart}).drop("_uu", "_uv", "_vv", "_uw", "_vw", "_s0", "_t0", "_t", "_s")


def close_segments(segments: DataFrame, reach: float, keys: list[str], name: str = "id") -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j of segments within ``reach`` of each other, each once.

    Samples are ``reach`` apart and cells twice as wide: the nearest points of two segments within reach
    lie within half a step of a sample each, so these are in the same or in neighbouring cells.
    """
    seg = segments.where(finite(*ENDS)).select(*keys, F.col(name).alias("id"), *[F.col(c).cast("double").alias(c) for c in ENDS])
    step, cell = F.lit(float(reach)), F.lit(2.0 * reach)
    left, right = (seg.select(*keys, F.col("id").alias(s), F.explode(crossed_cells(step, cell, around)).alias("_c")).select(*keys, s, "_c.*") for s, around in (("i", False), ("j", True)))
    pairs = left.join(right, [*keys, *CELL]).where("i < j").select(*keys, "i", "j").distinct()
    for s in "ij":
        pairs = pairs.join(seg.select(*keys, F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ENDS]), [*keys, s])
    met = with_segment_distance(pairs, "i_", "j_", "dist")
    return met.where(F.col("dist") <= reach).select(*keys, "i", "j", "dist")


def in_capsules(capsules: DataFrame, points: DataFrame, keys: list[str], crowd: int | None = None, hit: str = "hit_id") -> DataFrame:
    """Rows of ``points`` within the ``radius`` of a capsule's segment, with all columns of both sides, t and perp.

    ``capsules`` have keys, ends and radius, ``points`` keys, ``hit``, x, y, z, and no other names in common.
    t runs along the segment from its a end; perp is the distance to the infinite line.  Radii
    may differ: those up to the same power of two share a grid of their own.
    """
    most = CROWD if crowd is None else crowd
    caps = capsules.where(finite(*ENDS, "radius") & (F.col("radius") > 0)).withColumn("_level", F.ceil(F.log2("radius")).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level") + 1)
    on = [*keys, "_level", *CELL]
    levels = small(caps.select(*keys, "_level").distinct())
    there = points.where(finite("x", "y", "z")).join(levels, keys) if keys else points.where(finite("x", "y", "z")).crossJoin(levels)
    there = there.withColumns({f"_c{c}": F.floor(F.col(c) / width) for c in "xyz"})
    caps = caps.withColumn("_c", F.explode(crossed_cells(width, width, True))).select("*", "_c.*").drop("_c")
    full = there.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).alias("_slots"))
    full = small(full)
    slots = F.coalesce("_slots", F.lit(1))
    there = there.join(full, on, "left").withColumn("_slot", F.pmod(F.xxhash64(hit), slots)).drop("_slots")
    caps = caps.join(full, on, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), slots.cast("long") - 1))).drop("_slots")
    met = there.join(caps, [*on, "_slot"]).drop(*on[len(keys) :], "_slot")
    a, u = geom.vec("a"), geom.unit(geom.sub(geom.vec("b"), geom.vec("a")))
    met = pinned(met, {"t": geom.dot(geom.sub(geom.vec(), a), u), "perp": geom.line_distance(geom.vec(), a, u), "_d": geom.point_segment_distance(geom.vec(), a, geom.vec("b"))})
    return met.where(F.col("_d") <= F.col("radius")).drop("_d")


def tips(segments: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, end, x, y, z, ox, oy, oz): both ends of segments and the direction outwards there."""
    out = geom.unit(geom.sub(geom.vec("b"), geom.vec("a")))
    both = F.array(*[F.struct(F.lit(k).alias("end"), *[F.col(f"{e}{c}").alias(c) for c in "xyz"], *[(o * sign).alias(f"o{c}") for c, o in zip("xyz", out, strict=True)]) for k, (e, sign) in enumerate((("a", -1.0), ("b", 1.0)))])
    return segments.where(finite(*ENDS)).select(*keys, name, F.explode(both).alias("_t")).select(*keys, name, "_t.*")


def stitch_pairs(
    segments: DataFrame, hits: DataFrame, keys: list[str], name: str = "id", dist: float = 5.0, ends: float = 40.0, dot: float = -0.97, window: float = 8.0, trans: float | None = 5.0,
    weights: tuple[float, float, float] = (0.45, 0.35, 0.15),
) -> DataFrame:
    """Pairs of segments of different cells that continue each other, with whether each is accepted.

    (keys, i, j, end_i, end_j, dist, gap, dot, trans, score, accepted): the nearest ends within ``ends``,
    the segments drawn out to the event's box within ``dist``, outward directions at these ends (of hits within
    ``window`` in z) with a product of at most ``dot``, and the gap's part across within ``trans``.  A
    pair is accepted if it scores least at both of its ends.  ``segments`` have keys, ``name``, tpc,
    linearity and ends, ``hits`` keys, ``name``, x, y, z, e.
    """
    from cloudloom.operators.audit import bounding_boxes

    seg = segments.where(finite(*ENDS)).select(*keys, name, "tpc", "linearity", *ENDS)
    tip = tips(seg, keys, name)
    p, q = (tip.select(*keys, F.col(name).alias(s), F.col("end").alias(f"end_{s}"), "x", "y", "z") for s in "ij")
    best = eps_join(p, q, ends, keys).where("i < j").groupBy(*keys, "i", "j").agg(F.min(F.struct("dist", "end_i", "end_j")).alias("m"))
    pairs = best.select(*keys, "i", "j", F.col("m.dist").alias("gap"), "m.end_i", "m.end_j")
    box = bounding_boxes(hits, keys)
    drawn = seg.join(box, keys)
    axis = geom.unit(geom.sub(geom.vec("b"), geom.vec("a")))
    drawn = pinned(drawn, {f"u{c}": v for c, v in zip("xyz", axis, strict=True)})
    lo, hi = geom.extend_to_box(geom.vec("a"), geom.vec("u"), geom.vec("lo"), geom.vec("hi"))
    drawn = pinned(drawn, {"_lo": lo, "_hi": hi})
    far = {f"{e}{c}": F.when(F.col("_lo").isNull(), F.col(f"{e}{c}")).otherwise(F.col(f"a{c}") + F.col(f"u{c}") * F.col(t)) for e, t in (("a", "_lo"), ("b", "_hi")) for c in "xyz"}
    drawn = drawn.select(*keys, name, "tpc", "linearity", *[v.alias(k) for k, v in far.items()])
    for s in "ij":
        pairs = pairs.join(drawn.withColumnsRenamed({c: f"{s}_{c}" for c in ["tpc", "linearity", *ENDS]} | {name: s}), [*keys, s])
    pairs = pairs.where("i_tpc <> j_tpc")
    pairs = with_segment_distance(pairs, "i_", "j_", "dist").where(F.col("dist") <= dist)
    marks = tip.withColumnsRenamed({c: f"t{c}" for c in "xyz"})
    out = local_directions(hits, marks, [*keys, name], window, slab=True)
    for s in "ij":
        side = out.select(*keys, F.col(name).alias(s), F.col("end").alias(f"end_{s}"), *[F.col(f"{k}{c}").alias(f"{s}_{k}{c}") for k in "tu" for c in "xyz"])
        pairs = pairs.join(side, [*keys, s, f"end_{s}"])
    pairs = pinned(pairs, {"dot": geom.dot(geom.vec("i_u"), geom.vec("j_u"))}).where(F.col("dot") <= dot)
    pairs = pinned(pairs, {"trans": geom.gap_parts(geom.vec("i_t"), geom.vec("i_u"), geom.vec("j_t"), geom.vec("j_u"))[0]})
    if trans is not None:
        pairs = pairs.where(F.col("trans") <= trans)
    w_end, w_angle, w_line = weights
    score = F.col("dist") / dist + w_end * F.col("gap") / ends + w_angle * (1 + F.col("dot")) / max(1 + dot, 1e-6) - w_line * F.least("i_linearity", "j_linearity")
    pairs = pinned(pairs.select(*keys, "i", "j", "end_i", "end_j", "dist", "gap", "dot", "trans", "i_linearity", "j_linearity"), {"score": score})
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("s"), F.col("end_i").alias("end")), F.struct(F.col("j").alias("s"), F.col("end_j").alias("end")))).alias("side"), F.struct(F.round("score", 9).alias("score"), "i", "j").alias("rank"))
    first = sides.groupBy(*keys, "side").agg(F.min("rank").alias("rank")).groupBy(*keys, "rank").agg((F.count(F.lit(1)) == 2).alias("accepted"))
    first = first.select(*keys, F.col("rank.i").alias("i"), F.col("rank.j").alias("j"), "accepted")
    done = pairs.join(first, [*keys, "i", "j"], "left")
    return done.select(*keys, "i", "j", "end_i", "end_j", "dist", "gap", "dot", "trans", "score", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def corridors(pairs: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Capsules between two ends: ``pairs`` have keys, ends and other columns; adds gap and radius."""
    return pinned(pairs, {"gap": geom.distance(geom.vec("a"), geom.vec("b")), "radius": F.lit(float(radius))})


def active_share(rows: DataFrame, boxes: DataFrame, keys: list[str], samples: int = 19) -> DataFrame:
    """``rows`` (with ends) and the share ``active`` of samples from 5 to 95 % of the way that lie in a box of their event.

    ``boxes`` (keys, lox .. hiz) are the few cells of a detector, so those of an event stand beside its rows.
    """
    listed = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"])).alias("_boxes"))
    way = F.array(*[F.lit(0.05 + 0.9 * k / (samples - 1)) for k in range(samples)])
    place = lambda s, c: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * s

    def inside(s: Column) -> Column:
        def one(b: Column) -> Column:
            ok = F.lit(True)
            for c in "xyz":
                ok = ok & (place(s, c) >= b[f"lo{c}"]) & (place(s, c) <= b[f"hi{c}"])
            return ok

        return F.exists("_boxes", one)

    hit = F.aggregate(F.transform(way, lambda s: F.coalesce(inside(s), F.lit(False)).cast("int")), F.lit(0), lambda a, b: a + b)
    return rows.join(listed, keys, "left").withColumn("active", hit / F.lit(float(samples))).drop("_boxes")


def bridge_evidence(
    ends: DataFrame, hits: DataFrame, boxes: DataFrame, keys: list[str], radius: float = 2.5, least_gap: float = 4.0, least_active: float = 0.35, occupancy: float = 0.25, per_cm: float = 3.0, margin: float = 1.0
) -> DataFrame:
    """``ends`` (keys, pair, ends) with gap, active, n_bridge, need and bridged.

    Between two ends stands evidence if enough hits lie within ``radius`` of the line, ``margin`` or more from
    both; gaps up to ``least_gap`` and corridors mostly outside the boxes need none.
    """
    rows = active_share(corridors(ends, keys, radius), boxes, keys)
    # A capsule reaches as far as its line, so the hits across it are all those near the segment.
    met = in_capsules(rows.select(*keys, "pair", *ENDS, "gap", "radius"), hits.select(*keys, "hit_id", "x", "y", "z"), keys)
    n = met.where((F.col("perp") <= radius) & (F.col("t") > margin) & (F.col("t") < F.col("gap") - margin)).groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n_bridge"))
    out = rows.drop("radius").join(n, [*keys, "pair"], "left").fillna(0, ["n_bridge"])
    need = occupancy * F.col("active") * F.col("gap") * per_cm
    waived = (F.col("gap") <= least_gap) | (F.col("active") <= least_active)
    return out.withColumns({"need": need, "bridged": waived | (F.col("n_bridge") >= need)})


def continuations(lines: DataFrame, hits: DataFrame, keys: list[str], radius: float = 1.5, reach: float = 40.0, skip: float = 1.0, least: int = 10, dot: float = 0.95) -> DataFrame:
    """(keys, label, part, next, n, dot): the label that most hits beyond a line's span vote for, if they run its way.

    ``lines`` have keys, label, part, c, d, tmin, tmax; ``hits`` keys, label, hit_id, x, y, z, e.  Votes are the hits
    of other labels within ``radius`` of the line, from ``skip`` to ``reach`` beyond either end; of labels with
    equally many the least counts, and its voting hits must lie along a line within ``dot``.
    """
    from cloudloom.functions.moments import aggregates, with_axes

    tubes = []
    for first, last in ((F.col("tmax") + skip, F.col("tmax") + reach), (F.col("tmin") - reach, F.col("tmin") - skip)):
        ends = {f"{e}{c}": F.col(f"c{c}") + F.col(f"d{c}") * t for e, t in (("a", first), ("b", last)) for c in "xyz"}
        tubes.append(lines.select(*keys, F.col("label").alias("own"), "part", *[F.col(f"d{c}").alias(f"_d{c}") for c in "xyz"], *[v.alias(k) for k, v in ends.items()], F.lit(float(radius)).alias("radius")))
    upper = [F.lit(True), F.lit(False)]
    met = [in_capsules(t.withColumn("_up", up), hits.where("label >= 0").select(*keys, "label", "hit_id", "x", "y", "z", "e"), keys) for t, up in zip(tubes, upper, strict=True)]
    span = F.lit(reach - skip)
    # The near side is open, the far side closed, as the spans are measured from the line's own ends.
    inside = F.when(F.col("_up"), (F.col("t") > 0) & (F.col("t") <= span)).otherwise((F.col("t") >= 0) & (F.col("t") < span))
    votes = met[0].unionByName(met[1]).where((F.col("label") != F.col("own")) & (F.col("perp") <= radius) & inside)
    on = [*keys, "own", "part"]
    counted = votes.groupBy(*on, "label").agg(*aggregates(), *[F.first(f"_d{c}").alias(f"_d{c}") for c in "xyz"])
    top = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("n"), "label"))
    best = with_axes(counted.withColumn("_k", top).where((F.col("_k") == 1) & (F.col("n") >= least)).withColumnsRenamed({f"_d{c}": f"w{c}" for c in "xyz"}))
    best = pinned(best, {"dot": F.abs(geom.dot(geom.vec("d"), geom.vec("w")))}).where(F.col("dot") >= dot)
    return best.select(*keys, F.col("own").alias("label"), "part", F.col("label").alias("next"), "n", "dot")

