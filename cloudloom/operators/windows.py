"""Ordered operators: gap islands, dense relabelling, one-dimensional Otsu, gap density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, keys: list[str], order: list[str], step: str, gap, name: str = "island") -> DataFrame:
    """Number, from 0, runs of ``df`` ordered by ``order``: a new one where ``step`` grows by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.when(F.col(step) - F.lag(step).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", first).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def truth_groups(hits: DataFrame, keys: list[str], time: str = "t0", gap: float = 3.0, hit: str = "hit_id") -> DataFrame:
    """Group id of each hit with a finite time: chained while steps are at most ``gap``; others -1."""
    good = F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & (F.abs(F.col(time).cast("double")) < float("inf"))
    found = gap_islands(hits.where(good), keys, [time, hit], time, gap, "g")
    return found.unionByName(hits.where(~good).withColumn("g", F.lit(-1).cast("long")))


def runs(df: DataFrame, keys: list[str], at: str, gap: float, least: int = 1, tie: str = "hit_id") -> DataFrame:
    """(keys, run, n, first, last, length) of the axial runs with at least ``least`` rows."""
    cut = gap_islands(df, keys, [at, tie], at, gap, "run")
    out = cut.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return out.where(F.col("n") >= least).withColumn("length", F.col("last") - F.col("first"))


def gap_density_keep(df: DataFrame, keys: list[str], at: str, gap: float = 4.0, least: int = 25, length: float = 30.0, tie: str = "hit_id") -> DataFrame:
    """The run that each label keeps: the densest of those long enough; a label without a gap keeps all."""
    made = runs(df, keys, at, gap, 1, tie)
    w = Window.partitionBy(*keys)
    density = F.col("n") / F.greatest(F.col("length"), F.lit(1e-9))
    ranked = made.withColumns({"n_runs": F.count(F.lit(1)).over(w), "density": density})
    fit = ranked.where((F.col("n_runs") == 1) | ((F.col("n") >= least) & (F.col("length") >= length)))
    best = fit.withColumn("_k", F.row_number().over(w.orderBy(F.desc("density"), "run")))
    return best.where("_k = 1").drop("_k")


def dense_relabel(df: DataFrame, keys: list[str], label: str, name: str = "new_label") -> DataFrame:
    """Labels of each key renumbered 0, 1, ... in their order."""
    named = df.select(*keys, label).distinct().withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(label)) - 1)
    return df.join(named, [*keys, label])


def otsu_split(df: DataFrame, keys: list[str], value: str, tie: str = "hit_id") -> DataFrame:
    """(keys, threshold, n_low, n_high, separation): the split of greatest variance between classes.

    Prefix sums over the ordered values; of equal splits the lowest wins.  The threshold is the
    mean of the two values around it.
    """
    w = Window.partitionBy(*keys).orderBy(value, tie)
    whole = Window.partitionBy(*keys)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    s = df.select(*keys, value, F.row_number().over(w).alias("k"), F.sum(value).over(to_here).alias("low"), F.sum(value).over(whole).alias("all"), F.count(F.lit(1)).over(whole).alias("n"), F.lead(value).over(w).alias("next"))
    m0, m1 = F.col("low") / F.col("k"), (F.col("all") - F.col("low")) / (F.col("n") - F.col("k"))
    s = s.where("k < n").withColumns({"between": F.round(F.col("k") * (F.col("n") - F.col("k")) * (m1 - m0) ** 2 / F.col("n") ** 2, 9), "separation": m1 - m0})
    best = s.withColumn("_r", F.row_number().over(whole.orderBy(F.desc("between"), "k"))).where("_r = 1")
    return best.select(*keys, ((F.col(value) + F.col("next")) / 2).alias("threshold"), F.col("k").alias("n_low"), (F.col("n") - F.col("k")).alias("n_high"), "separation")


def max_internal_gap(df: DataFrame, keys: list[str], at: str, tie: str = "hit_id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return df.withColumn("_gap", F.col(at) - F.lag(at).over(w)).groupBy(*keys).agg(F.coalesce(F.max("_gap"), F.lit(0.0)).alias("max_gap"))


def density_bins(df: DataFrame, keys: list[str], at: str, weight: str, width: float) -> DataFrame:
    """(keys, bin, e, w, rho): energy by axial bin; a last bin under half as wide joins the one before."""
    w = Window.partitionBy(*keys)
    ext = df.withColumns({"_lo": F.min(at).over(w), "_hi": F.max(at).over(w)})
    span = F.col("_hi") - F.col("_lo")
    full = F.greatest(F.ceil(span / width), F.lit(1)).cast("long")
    rest = span - (full - 1) * width
    n = F.when((full > 1) & (rest < width / 2), full - 1).otherwise(full)
    b = F.least(F.floor((F.col(at) - F.col("_lo")) / width).cast("long"), n - 1)
    last = F.col("bin") == F.col("n_bins") - 1
    rows = ext.withColumns({"n_bins": n, "bin": b, "_span": span})
    out = rows.groupBy(*keys, "bin", "n_bins", "_span").agg(F.sum(weight).alias("e"))
    size = F.when(last, F.col("_span") - (F.col("n_bins") - 1) * width).otherwise(F.lit(width))
    return out.withColumn("w", size).withColumn("rho", F.col("e") / F.greatest("w", F.lit(1e-9))).drop("_span")


def rows_per(keys: list[str], n: Column | int, order: list) -> Column:
    """Whether a row is among the first ``n`` of its key in an order (for limits per file)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n
