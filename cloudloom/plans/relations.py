"""The clustering chain as relations: every stage is joins and aggregations over all events at once, with its labels kept.

Segments of cells come from radius components that are line-like, or from any other finder; they are stitched across
cells, take up noise around their lines, and what is left is clustered by density; tracks whose ends continue each
other over a bridged gap are rejoined, tracks that meet at an angle merged, and crumbs given to their nearest
neighbour.  No event is gathered in one task, so an event may be of any size; each stage is written, and a lost
executor costs its own tasks of one stage.

Defined results: hits of no segment and no cluster are noise (-1); track labels come before those of clusters; merged
labels keep the least; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import ends, line_moments, local_directions, pinned
from cloudloom.operators import audit, density, segments, stages
from cloudloom.operators.graph import greedy_exclusive, stored
from cloudloom.operators.metrics import dominant, purity_completeness
from cloudloom.operators.spatial import eps_join
from cloudloom.plans.config import ChainConfig

STAGES = ("segments", "stitch", "absorb", "leftover", "rejoin", "vertex", "fragments")


def line_components(hits: DataFrame, keys: list[str], cfg: ChainConfig) -> DataFrame:
    """(keys, tpc, hit_id, segment): radius components of a cell that have enough hits and lie along a line."""
    cell = [*keys, "tpc"]
    found = stored(density.radius_components(hits, cfg.rescue_eps, cell))
    named = hits.join(found.select(*cell, "hit_id", F.col("component").alias("segment")), [*cell, "hit_id"])
    good = line_moments(named, [*cell, "segment"]).where((F.col("n") >= cfg.rescue_hits) & (F.col("length") >= cfg.rescue_length) & (F.col("linearity") >= cfg.rescue_linearity) & (F.col("rms") <= cfg.rescue_rms))
    return named.join(good.select(*cell, "segment"), [*cell, "segment"], "left_semi").select(*cell, "hit_id", "segment")


def _rejoin(hits: DataFrame, keys: list[str], cfg: ChainConfig) -> DataFrame:
    """(keys, a, b): tracks (label below split) whose ends continue each other; each end joins once, the best first."""
    tracks = hits.where((F.col("label") >= 0) & (F.col("label") < F.col("split")))
    lines = stored(ends(line_moments(tracks, [*keys, "label"])).where(F.col("length") >= 10))
    tip = segments.tips(lines, keys, "label")
    out = stored(local_directions(tracks.select(*keys, "label", "x", "y", "z", "e"), tip.withColumnsRenamed({c: f"t{c}" for c in "xyz"}), [*keys, "label"], 10.0))
    side = lambda s: out.select(*keys, F.col("label").alias(s), F.col("end").alias(f"end_{s}"), *[F.col(f"t{c}").alias(c) for c in "xyz"], *[F.col(f"u{c}").alias(f"{s}_u{c}") for c in "xyz"])
    met = eps_join(side("a"), side("b"), cfg.rejoin_gap, keys).where("a < b")
    met = pinned(met, {"dot": geom.dot(geom.vec("a_u"), geom.vec("b_u"))}).where(F.col("dot") <= cfg.rejoin_dot)
    met = pinned(met, {"trans": geom.gap_parts(geom.vec(), geom.vec("a_u"), geom.vec("r"), geom.vec("b_u"))[0]}).where(F.col("trans") <= cfg.rejoin_trans)
    rows = met.select(*keys, F.concat_ws("-", "a", "end_a", "b", "end_b").alias("pair"), (F.col("a") * 2 + F.col("end_a")).alias("a"), (F.col("b") * 2 + F.col("end_b")).alias("b"), *[F.col(f"{s}{c}").alias(f"{e}{c}") for e, s in (("a", ""), ("b", "r")) for c in "xyz"], "dot", "trans", F.col("dist").alias("_gap"))
    rows = stored(rows)
    boxes = audit.bounding_boxes(hits, [*keys, "tpc"]).drop("tpc")
    seen = segments.bridge_evidence(rows.drop("a", "b"), hits, boxes, keys, cfg.rejoin_radius, cfg.rejoin_min_gap, cfg.rejoin_active, cfg.rejoin_occupancy).where("bridged").select(*keys, "pair")
    score = F.col("trans") / cfg.rejoin_trans + (1 + F.col("dot")) / max(1 + cfg.rejoin_dot, 1e-6) + F.col("_gap") / cfg.rejoin_gap
    edges = rows.join(seen, [*keys, "pair"], "left_semi").select(*keys, F.round(score, 9).alias("score"), "a", "b")
    taken = greedy_exclusive(edges, keys)
    return taken.select(*keys, F.floor(F.col("a") / 2).alias("a"), F.floor(F.col("b") / 2).alias("b"))


def chain(hits: DataFrame, keys: list[str], found: DataFrame | None = None, config: ChainConfig | None = None) -> DataFrame:
    """(keys, hit_id, label, split, at_<stage> ...): labels after all stages and after each; labels below split are tracks.

    ``hits`` have keys, hit_id, x, y, z, e, tpc; ``found`` (keys, tpc, hit_id, segment) are segments of another finder.
    """
    cfg = config or ChainConfig.of()
    hits = hits.select(*keys, "hit_id", "x", "y", "z", "e", "tpc")
    found = stored(line_components(hits, keys, cfg) if found is None else found.select(*keys, "tpc", "hit_id", "segment"))
    order = Window.partitionBy(*keys).orderBy("tpc", "segment")
    names = found.select(*keys, "tpc", "segment").distinct().withColumn("label", (F.row_number().over(order) - 1).cast("long"))
    named = found.join(names, [*keys, "tpc", "segment"]).select(*keys, "hit_id", "label")
    rows = hits.join(named, [*keys, "hit_id"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
    rows = stored(rows.withColumn("at_segments", F.col("label")))

    def keep(df: DataFrame, stage: str) -> DataFrame:
        return stored(df.withColumn(f"at_{stage}", F.col("label")))

    tracks = rows.where("label >= 0")
    seg = stored(ends(line_moments(tracks.withColumn("id", F.col("label")), [*keys, "id", "tpc"])))
    joined = segments.stitch_pairs(seg, tracks.withColumn("id", F.col("label")), keys, dist=cfg.stitch_dist, ends=cfg.stitch_end, dot=cfg.stitch_dot, window=cfg.stitch_window, trans=cfg.stitch_trans).where("accepted")
    rows = keep(stages.apply_merges(rows, stored(joined.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"))), keys), "stitch")

    near = stages.absorb_into_tracks(rows.where("label < 0"), rows.where("label >= 0"), keys, lam=cfg.lam, scale=cfg.absorb_scale, base=cfg.absorb_base, margin=cfg.absorb_margin)
    rows = rows.join(near.select(*keys, "hit_id", "track"), [*keys, "hit_id"], "left").withColumn("label", F.coalesce("track", "label")).drop("track")
    rows = keep(rows, "absorb")

    rest = stored(density.dbscan(rows.where("label < 0"), cfg.leftover_eps, cfg.leftover_min, keys).where("cluster >= 0"))
    top = rows.groupBy(*keys).agg((F.max("label") + 1).alias("split"))
    rows = rows.join(top, keys).join(rest, [*keys, "hit_id"], "left").withColumn("label", F.when(F.col("cluster").isNotNull(), F.col("split") + F.col("cluster")).otherwise(F.col("label"))).drop("cluster")
    rows = keep(rows, "leftover")

    rows = keep(stages.apply_merges(rows, stored(_rejoin(rows, keys, cfg)), keys), "rejoin")
    pairs = stages.vertex_merge_pairs(rows.where((F.col("label") >= 0) & (F.col("label") < F.col("split"))), keys)
    rows = keep(stages.apply_merges(rows, stored(pairs), keys, cfg.merge_max_group), "vertex")
    rows = keep(stages.absorb_fragments(rows, keys, cfg.frag_hits, cfg.frag_radius), "fragments")
    return rows.select(*keys, "hit_id", "label", "split", *[f"at_{s}" for s in STAGES])


def stage_scores(labels: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stage, place, purity, completeness, n_clusters, foreign) of each stage's labels; ``truth`` has keys, hit_id, g, e."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("stage"), F.col(f"at_{s}").alias("label")) for k, s in enumerate(STAGES)]))
    rows = stored(labels.select(*keys, "hit_id", each.alias("_s")).select(*keys, "hit_id", "_s.*").join(truth.select(*keys, "hit_id", "g", "e"), [*keys, "hit_id"]))
    on = [*keys, "stage", "place"]
    score = purity_completeness(rows, on).select(*on, "purity", "completeness", "n_clusters")
    return score.join(dominant(rows, on).groupBy(*on).agg(F.sum("e_foreign").alias("foreign")), on)
