"""Cluster catalog, broken-track pairs, flags and focus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import ends, line_moments, pinned
from cloudloom.operators.metrics import dominant, labelled, true_hit


def purity_catalog(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cluster with truth: size, geometry, purity, foreign energy, top foreign groups, hint.

    Hint: one cell with over half of the foreign energy, and over four times as much as the
    cluster's own there, is a bad stitch; foreign hits that lie much farther off the line than
    the cluster's own are an attached blob; else they are mixed in.
    """
    on = [*keys, "label"]
    real = hits.where(labelled())
    d = dominant(hits, keys)
    geo = line_moments(real, on).select(*on, F.col("n").alias("n_hits"), F.col("e").alias("e_total"), "length", "linearity", "cx", "cy", "cz", "dx", "dy", "dz")
    cells = real.groupBy(*on).agg(F.count_distinct("tpc").alias("n_tpcs"))
    named = real.where(true_hit()).join(d.select(*on, "dom"), on)
    own = F.col("g") == F.col("dom")
    per_cell = named.groupBy(*on, "tpc").agg(F.sum(F.when(own, F.col("e")).otherwise(0.0)).alias("own"), F.sum(F.when(~own, F.col("e")).otherwise(0.0)).alias("other"))
    worst = per_cell.groupBy(*on).agg(F.max(F.struct("other", (-F.col("tpc")).alias("minus"), "own")).alias("w"), F.sum("other").alias("foreign"))
    perp = named.join(geo.select(*on, "cx", "cy", "cz", "dx", "dy", "dz"), on).withColumn("perp", geom.line_distance(geom.vec(), geom.vec("c"), geom.vec("d")))
    spread = perp.groupBy(*on).agg(F.percentile(F.when(~own, F.col("perp")), 0.5).alias("far"), F.percentile(F.when(own, F.col("perp")), 0.9).alias("near"))
    by_group = named.where(~own).groupBy(*on, "g").agg(F.sum("e").alias("e"))
    k = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("e"), "g"))
    top = by_group.withColumn("k", k).where("k <= 2").groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda x: x["g"].cast("string")), ";").alias("top_foreign"))
    stitch = (F.col("w.other") > 0.5 * F.col("foreign")) & (F.col("w.other") > 4 * F.greatest(F.col("w.own"), F.lit(1e-9)))
    hint = F.when(F.col("e_foreign") <= 0, "").when(stitch, F.concat(F.lit("stitch:"), (-F.col("w.minus")).cast("string"))).when(F.col("far") > 1.5 * F.greatest(F.col("near"), F.lit(1e-9)), "blob").otherwise("mixed")
    out = d.where("e_truth > 0").join(geo, on).join(cells, on).join(worst, on, "left").join(spread, on, "left").join(top, on, "left")
    return out.select(*on, "n_hits", "e_total", "e_truth", "length", "n_tpcs", "linearity", (F.col("e_dom") / F.col("e_truth")).alias("purity"), "e_foreign", "dom", F.coalesce("top_foreign", F.lit("")).alias("top_foreign"), hint.alias("hint"))


def broken_pairs(lines: DataFrame, keys: list[str], angle: float = 15.0, gap: float = 80.0, offset: float = 8.0, shortest: float = 15.0) -> DataFrame:
    """Pairs of long lines (keys, label, dom, moments) of one truth group that continue each other."""
    cols = ["label", "cx", "cy", "cz", "dx", "dy", "dz", "ax", "ay", "az", "bx", "by", "bz"]
    good = ends(lines.where(F.col("length") > shortest)).select(*keys, "dom", *cols)
    a, b = (good.withColumnsRenamed({c: f"{s}_{c}" for c in cols}) for s in ("l", "r"))
    v = lambda s, k: geom.vec(f"{s}_{k}")
    tips = [(v("l", i), v("r", j)) for j in "ab" for i in "ab"]
    gaps = [geom.distance(p, q) for p, q in tips]
    r = F.when(F.least(gaps[0], gaps[1]) <= F.least(gaps[2], gaps[3]), F.lit(0)).otherwise(1)
    off = [geom.line_distance(v("r", j), v("l", "c"), v("l", "d")) for j in "ab"]
    pairs = a.join(b, [*keys, "dom"]).where("l_label < r_label")
    pairs = pinned(pairs, {"angle": geom.angle_degrees(v("l", "d"), v("r", "d"))}).where(F.col("angle") <= angle)
    pairs = pinned(pairs, {"gap": F.least(*gaps)}).where(F.col("gap") <= gap)
    pairs = pinned(pairs, {"offset": F.when(r == 0, off[0]).otherwise(off[1])}).where(F.col("offset") <= offset)
    return pairs.select(*keys, "dom", F.col("l_label").alias("label_a"), F.col("r_label").alias("label_b"), "gap", "angle", "offset")


def two_track_flag(hits: DataFrame, keys: list[str], least: int = 40, length: float = 15.0, perp: float = 1.2, dedx: float = 2.0) -> DataFrame:
    """Labels with cells where they are both wide and dense, as two tracks in one are."""
    on = [*keys, "label", "tpc"]
    sizes = hits.where(labelled()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_all")).where(F.col("n_all") >= least)
    windows = line_moments(hits.join(sizes.drop("n_all"), [*keys, "label"], "left_semi"), on)
    hot = windows.where((F.col("n") >= least) & (F.col("length") >= length) & (F.col("q50") >= perp) & (F.col("e") / F.col("length") >= dedx))
    return hot.groupBy(*keys, "label").agg(F.array_sort(F.collect_list("tpc")).alias("cells"))


def bounding_boxes(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def depth_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest depth of each point in the boxes of its event (0 if in none); boxes are a few a event."""
    inside = F.greatest(F.max(geom.depth_in_box(geom.vec(), geom.vec("lo"), geom.vec("hi"))), F.lit(0.0))
    met = points.join(boxes, keys) if keys else points.crossJoin(F.broadcast(boxes))
    return met.groupBy(*[c for c in points.columns]).agg(inside.alias("depth"))


def in_any_box(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with whether each lies in a box of its event (faces included)."""
    depth = geom.depth_in_box(geom.vec(), geom.vec("lo"), geom.vec("hi"))
    return points.join(boxes, keys).groupBy(*points.columns).agg((F.max(depth) >= 0).alias("active"))


def reason_counts(rows: DataFrame, keys: list[str], reason: str = "reason") -> DataFrame:
    """How often each reject reason occurred."""
    return rows.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))


def focus(hits: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Own, foreign and context hits in the cells that the ``wanted`` labels (keys, label) touch."""
    own = hits.join(wanted, [*keys, "label"], "left_semi")
    cells = own.select(*keys, "tpc").distinct()
    mark = wanted.distinct().withColumn("_own", F.lit(True))
    around = hits.join(cells, [*keys, "tpc"], "left_semi").join(mark, [*keys, "label"], "left")
    role = F.when(F.col("_own").isNull(), "context").otherwise("own")
    return around.withColumn("role", role).drop("_own")


def selected_summary(hits: DataFrame, keys: list[str], cells: list[int]) -> DataFrame:
    """Labels that touch the chosen cells: hits and energy there."""
    return hits.where(F.col("tpc").isin(cells)).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), F.array_sort(F.collect_set("tpc")).alias("cells"))


def event_list(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.sum("e").alias("e"), F.count_distinct("label").alias("n_labels"))


def events_up_to(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events of each file."""
    k = F.row_number().over(Window.partitionBy("file_tag").orderBy("event_id"))
    return events.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")
