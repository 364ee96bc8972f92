"""Scores that grow with their input: contingency tables whose partial sums merge in any order.

A partial has (keys, label, g, e, n) with sums for every pair of label and truth group, nulls for noise
and for hits without truth; labels and groups may be of any ordered type.  Sums of partials of any
cut of the hits are the sums of the whole, so an incremental job keeps one partial for each intake
and never reads old hits again.  Energies are summed as decimals of nine places, so that the sums are
exactly the same in whatever order hits and partials come.  All are aggregations that combine map-side: a frequent label or
group never meets in one task.

Defined results: energies that are null or no finite number count as 0 and negative ones are clipped to 0; of groups with equal energy
the least is dominant; labels without truth have no dominant group and a null purity; repeated hits
count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Energies as they are summed.
ENERGY = "decimal(28,9)"


def partial_contingency(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, g, e, n) of hits with keys, label, g and e."""
    e = F.greatest(F.coalesce(F.col("e").cast("double").try_cast(ENERGY), F.lit(0).cast(ENERGY)), F.lit(0).cast(ENERGY))
    return hits.groupBy(*keys, "label", "g").agg(F.sum(e).alias("e"), F.count(F.lit(1)).alias("n"))


def merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The contingency table that partials add up to."""
    return partials.groupBy(*keys, "label", "g").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))


def label_catalog(table: DataFrame, keys: list[str], top: int = 2) -> DataFrame:
    """(keys, label, n, e, e_truth, dom, e_dom, purity, e_foreign, n_groups, top_foreign) of each label.

    ``top_foreign`` names the ``top`` groups of most energy that are not dominant, with semicolons.
    """
    on = [*keys, "label"]
    known = F.col("g").isNotNull()
    rows = table.where(F.col("label").isNotNull())
    none = F.lit(0).cast(ENERGY)
    sums = rows.groupBy(*on).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum(F.when(known, F.col("e"))).alias("e_truth"), F.count(F.when(known, 1)).alias("n_groups"))
    order = Window.partitionBy(*on).orderBy(F.desc("e"), "g")  # with the limit below Spark cuts each task's part before it shuffles
    best = rows.where(known).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top + 1)
    first, name = F.col("_k") == 1, F.when(F.col("_k") > 1, F.struct("_k", F.col("g").cast("string").alias("g")))
    best = best.groupBy(*on).agg(F.max(F.when(first, F.col("g"))).alias("dom"), F.max(F.when(first, F.col("e"))).alias("e_dom"), F.array_sort(F.collect_list(name)).alias("_top"))
    out = sums.join(best, on, "left")
    shown = F.coalesce(F.array_join(F.transform("_top", lambda x: x["g"]), ";"), F.lit(""))
    number = {"e": F.col("e"), "e_truth": F.coalesce("e_truth", none), "e_dom": F.coalesce("e_dom", none), "e_foreign": F.coalesce(F.col("e_truth") - F.col("e_dom"), none)}
    e = {name: value.cast("double").alias(name) for name, value in number.items()}
    purity = F.when(F.col("e_truth") > 0, F.col("e_dom").cast("double") / F.col("e_truth").cast("double"))
    return out.select(*on, "n", e["e"], e["e_truth"], "dom", e["e_dom"], purity.alias("purity"), e["e_foreign"], "n_groups", shown.alias("top_foreign"))


def event_scores(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, e, e_noise, e_truthless, purity, completeness, n_labels, n_groups) of each event."""
    label, group = F.col("label").isNotNull(), F.col("g").isNotNull()
    energy = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("e"))), F.lit(0).cast(ENERGY)).cast("double")
    whole = table.groupBy(*keys).agg(F.sum("n").alias("n"), energy(F.lit(True)).alias("e"), energy(~label).alias("e_noise"), energy(label & ~group).alias("e_truthless"))
    both = table.where(label & group)
    sides = []
    for column, share, count in (("label", "purity", "n_labels"), ("g", "completeness", "n_groups")):
        best = both.groupBy(*keys, column).agg(F.max("e").alias("top"), F.sum("e").alias("sum"))
        total = F.sum("sum")
        sides.append(best.groupBy(*keys).agg(F.when(total > 0, F.sum("top").cast("double") / total.cast("double")).alias(share), F.count(F.lit(1)).alias(count)))
    join = (lambda a, b: a.join(b, keys, "left")) if keys else (lambda a, b: a.crossJoin(b))  # without keys each side is one row
    out = join(join(whole, sides[0]), sides[1])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_labels", "n_groups")})
