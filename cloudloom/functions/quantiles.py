"""Exact quantiles of groups of any size: histograms narrow the range around a rank until few values are left.

``percentile`` gathers a group's values in one task.  Here groups of more than ``large`` rows are refined
instead: each round counts their values in bins between the range's ends (combined map-side), and the bin that
holds the rank is the next range, from its least to its greatest value.  A range is done when it holds one value
or few rows, which are then ranked.  Rounds read the data again, at most about log(rows) / log(bins) times;
what they carry is one row for each large group and rank.

Defined results: nulls, NaN and infinities count for nothing; a group without values has null quantiles; values that repeat take
as many ranks as they occur; quantiles between two ranks are interpolated, as ``percentile`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.graph import stored

#: Rows of a group up to which it is one task's work.
LARGE = 1_000_000
BINS = 4096
#: Rows of a range that are ranked by one task.
FEW = 10_000
#: Ranges up to which they are broadcast.
BROADCAST_ROWS = 200_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], large: int | None = None, bins: int | None = None, few: int | None = None) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles of ``value`` at ``shares`` in each group of ``keys``."""
    large, bins, few = large or LARGE, bins or BINS, few or FEW
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("_v"))
    sizes = stored(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    names = [f"q{k}" for k in range(len(shares))]
    big = sizes.where(F.col("_n") > large)
    joined = lambda left, right, how="inner": left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, keys, how)
    small = joined(rows, big.select(*keys), "left_anti") if keys else rows.where(F.lit(sizes.first()["_n"] <= large))
    out = small.groupBy(*keys).agg(*[F.percentile("_v", s).alias(n) for s, n in zip(shares, names, strict=True)])
    if big.isEmpty():
        return out

    # One row for each large group and rank that a quantile needs: the two around it.
    ranks = F.array(*[F.struct(F.lit(k).alias("_q"), F.lit(part).alias("_part"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("_at")) for k, s in enumerate(shares) for part in (0, 1)])
    todo = big.withColumn("_s", F.explode(ranks)).select(*keys, "_n", "_lo", "_hi", "_s.*")
    todo = todo.withColumn("_r", F.when(F.col("_part") == 0, F.floor("_at")).otherwise(F.ceil("_at")))
    todo = stored(todo.select(*keys, "_q", "_part", "_at", "_r", "_lo", "_hi", F.col("_n").alias("_within")))
    names_on = [*keys, "_q", "_part"]
    found = todo.where(F.col("_lo") == F.col("_hi")).select(*names_on, "_at", F.col("_lo").alias("_value"))
    left = stored(todo.where(F.col("_lo") < F.col("_hi")))
    ready = left.limit(0)
    while True:
        ready = ready.unionByName(left.where(F.col("_within") <= few))
        left = stored(left.where(F.col("_within") > few))
        if left.isEmpty():
            break
        near = _inside(rows, left, keys)
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("long"), F.lit(bins - 1))
        counted = near.withColumn("_bin", place).groupBy(*names_on, "_at", "_r", "_bin").agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_k").over(Window.partitionBy(*names_on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
        hit = counted.withColumn("_before", before).where((F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_k")))
        now = stored(hit.select(*names_on, "_at", (F.col("_r") - F.col("_before")).alias("_r"), "_lo", "_hi", F.col("_k").alias("_within")))
        found = found.unionByName(now.where(F.col("_lo") == F.col("_hi")).select(*names_on, "_at", F.col("_lo").alias("_value")))
        left = stored(now.where(F.col("_lo") < F.col("_hi")))
    ranked = _inside(rows, ready, keys).withColumn("_place", F.row_number().over(Window.partitionBy(*names_on).orderBy("_v")) - 1)
    found = found.unionByName(ranked.where(F.col("_place") == F.col("_r")).select(*names_on, "_at", F.col("_v").alias("_value")))
    both = found.groupBy(*keys, "_q").agg(F.max("_at").alias("_at"), F.max(F.when(F.col("_part") == 0, F.col("_value"))).alias("a"), F.max(F.when(F.col("_part") == 1, F.col("_value"))).alias("b"))
    share = F.col("_at") - F.floor("_at")
    both = both.withColumn("_value", F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")))
    wide = both.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == k, F.col("_value"))).alias(n) for k, n in enumerate(names)])
    return out.unionByName(wide) if keys else wide


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` beside each range of their group that they lie in."""
    r = ranges if ranges.count() > BROADCAST_ROWS else F.broadcast(ranges)
    met = rows.join(r, keys) if keys else rows.crossJoin(r)  # without keys the ranges are two rows for each share
    return met.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
