"""What became of labels: the overlaps of two labellings of the same hits, their components, and verdicts against truth.

Labels before and after are the two sides of a graph whose edges are shared hits; a component without a branch
kept its label, one with branches on one side was split or merged, on both it is mixed.  Hits that changed between a label
and noise count beside that: a kept label that lost hits was peeled, one that gained was fed.  Everything is made
of one aggregation over hits (map-side combined); the graph has an edge for each pair of labels that share hits.

Defined results: labels below zero or null are noise; hits of one side only count as noise on the other; a label that
is all noise afterwards is lost, one that was all noise before is new; ties of dominant groups go to the least; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.graph import connected_components, stored
from cloudloom.operators.metrics import level


def overlaps(before: DataFrame, after: DataFrame, on: list[str], keys: list[str], energy: str = "e") -> DataFrame:
    """(keys, old, new, n, e): hits and energy by label before and after; null for noise.  ``before`` has the energy."""
    real = lambda c: F.when(F.col(c) >= 0, F.col(c))
    old = before.select(*on, real("label").alias("old"), F.col(energy).alias("_e"))
    new = after.select(*on, real("label").alias("new"))
    both = old.join(new, on, "full_outer")
    return both.groupBy(*keys, "old", "new").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_e", F.lit(0.0))).alias("e"))


def lineage(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, kind, olds, news, e_kept, e_lost, e_gained, n) of each component of an overlap ``table``.

    ``component`` is its least label (before, else after); kinds are kept, peeled, fed, split, merged, mixed, lost and new.
    ``e_kept`` is the energy that stays among labels, ``e_lost`` what went to noise and ``e_gained`` what came from it.
    """
    table = stored(table.where("old is not null or new is not null"))
    named = table.select(*keys, F.lit(0).alias("side"), F.col("old").alias("label")).unionByName(table.select(*keys, F.lit(1).alias("side"), F.col("new").alias("label")))
    nodes = stored(named.where("label is not null").distinct().withColumn("node", F.monotonically_increasing_id()))
    side = lambda s, name, c: nodes.where(F.col("side") == s).select(*keys, F.col("label").alias(c), F.col("node").alias(name))
    edges = table.where("old is not null and new is not null").join(side(0, "a", "old"), [*keys, "old"]).join(side(1, "b", "new"), [*keys, "new"])
    comps = connected_components(edges.select("a", "b"))
    nodes = nodes.join(comps, "node", "left").select(*keys, "side", "label", F.coalesce("component", "node").alias("root"))
    sides = nodes.groupBy(*keys, "root").agg(F.count(F.when(F.col("side") == 0, 1)).alias("olds"), F.count(F.when(F.col("side") == 1, 1)).alias("news"), F.min(F.struct("side", "label")).alias("_first"))
    # Every row of the table belongs to the component of the label that it has.
    at = nodes.select(*keys, F.col("label").alias("old"), F.col("root").alias("_ro")).where(F.col("side") == 0), nodes.select(*keys, F.col("label").alias("new"), F.col("root").alias("_rn")).where(F.col("side") == 1)
    rows = table.join(at[0], [*keys, "old"], "left").join(at[1], [*keys, "new"], "left").withColumn("root", F.coalesce("_ro", "_rn"))
    e = lambda cond: F.sum(F.when(cond, F.col("e")).otherwise(0.0))
    o, n = F.col("old").isNotNull(), F.col("new").isNotNull()
    sums = rows.groupBy(*keys, "root").agg(e(o & n).alias("e_kept"), e(o & ~n).alias("e_lost"), e(~o & n).alias("e_gained"), F.sum(F.when(o & ~n, F.col("n")).otherwise(0)).alias("_lost"), F.sum(F.when(~o & n, F.col("n")).otherwise(0)).alias("_gained"), F.sum("n").alias("n"))
    olds, news = F.col("olds"), F.col("news")
    kind = (
        F.when(news == 0, "lost").when(olds == 0, "new").when((olds > 1) & (news > 1), "mixed").when(news > 1, "split").when(olds > 1, "merged")
        .when(F.col("_lost") > 0, "peeled").when(F.col("_gained") > 0, "fed").otherwise("kept")
    )
    out = sides.join(sums, [*keys, "root"])
    return out.select(*keys, F.col("_first.label").alias("component"), kind.alias("kind"), "olds", "news", "e_kept", "e_lost", "e_gained", "n")


def separation_audit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new, e_new, e_foreign, verdict): what parted from each label, held against the part that kept its name.

    ``hits`` have keys, old, new, g, e.  A part (another label, or noise: null) is ``separated`` if its dominant
    truth group is not that of the keeper, the largest part where the name is gone; ``broke_same`` if it is, ``no_truth``
    if either has none.  ``e_foreign`` is the part's energy of other groups than the keeper's.
    """
    real = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rows = hits.select(*keys, real("old").alias("old"), real("new").alias("new"), real("g").alias("g"), "e").where("old is not null")
    table = rows.groupBy(*keys, "old", "new", "g").agg(F.sum("e").alias("e"))
    parts = table.groupBy(*keys, "old", "new").agg(F.sum("e").alias("e_new"), F.max(F.when(F.col("g").isNotNull(), F.struct(level("e").alias("level"), (-F.col("g")).alias("minus")))).alias("_d"))
    parts = stored(parts.select(*keys, "old", "new", "e_new", (-F.col("_d.minus")).alias("dom")))
    rank = F.struct((F.coalesce(F.col("new") == F.col("old"), F.lit(False))).alias("same"), level("e_new").alias("level"), (-F.coalesce("new", F.lit(-1))).alias("minus"))
    keeper = parts.where("new is not null").groupBy(*keys, "old").agg(F.max(F.struct(rank.alias("r"), "new", "dom")).alias("k")).select(*keys, "old", F.col("k.new").alias("keeper"), F.col("k.dom").alias("keeper_dom"))
    moved = parts.join(keeper, [*keys, "old"]).where(F.col("new").isNull() | (F.col("new") != F.col("keeper")))
    verdict = F.when(F.col("dom").isNull() | F.col("keeper_dom").isNull(), "no_truth").when(F.col("dom") == F.col("keeper_dom"), "broke_same").otherwise("separated")
    foreign = table.join(keeper.select(*keys, "old", "keeper_dom"), [*keys, "old"]).where(F.col("g").isNotNull() & (F.col("g") != F.col("keeper_dom"))).groupBy(*keys, "old", F.coalesce("new", F.lit(-1)).alias("_new")).agg(F.sum("e").alias("e_foreign"))
    out = moved.withColumn("_new", F.coalesce("new", F.lit(-1))).join(foreign, [*keys, "old", "_new"], "left")
    return out.select(*keys, "old", "new", "e_new", F.coalesce("e_foreign", F.lit(0.0)).alias("e_foreign"), verdict.alias("verdict"))
