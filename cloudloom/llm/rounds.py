"""Verified links among nodes that meet in index keys, without all pairs of a crowded key.

An index gives each node a few keys; two nodes that share one and are close are a candidate pair.
Candidates are verified by bringing one node's payload to the other's.  Links only serve to
connect: a pair is spared if and only if its nodes are connected already, so the classes are
those of all verified pairs.

Each key is first a star: its hub, by a hash that is the same in all keys, is held against its
other nodes.  Then keys of at most ``CROWD`` nodes give those pairs that their stars have not
connected.  In a crowded key hubs are taken from what stands outside its largest class, held
against all of the key and leave it; more are taken in each round, until every key is one class.
Of the candidates each class has a few verified first, then more in each round, until those left
stand inside one class.  So a group of copies costs its size, however few nodes its keys have, and
what is no copy is compared in full.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import checkpoint
from cloudloom.operators.graph import connected_components, stored

#: Nodes of one key beyond which its pairs are not made at once, and hubs that it has first, after its star.
CROWD = 64
#: Pairs of one node that are verified in one call.
SLICE = 500
#: Rows of a table up to which it may be broadcast.
BROADCAST_ROWS = 200_000
#: Keys, one long each, up to which they may be broadcast.
BROADCAST_KEYS = 2_000_000
#: Rows of a partition of what a round leaves: with fewer rows in all it is one task, and what follows needs no shuffle.
PART_ROWS = 50_000
#: Pairs of each class that the first round verifies.
START = 16
#: How many times as many hubs, and pairs of a class, a round takes as the one before.
MORE = 64


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` checkpointed, in partitions of about ``PART_ROWS`` however many made it, and its rows.

    Rounds leave little, in as many partitions as a shuffle has, and unions add theirs up; each would
    be a task, and files, of every later step.
    """
    df = checkpoint(df)
    n = df.count()
    return df.coalesce(max(1, ceil(n / PART_ROWS))), n


def meeting(index: DataFrame) -> DataFrame:
    """Rows of ``index`` (key, ...) whose key stands in several; the others meet nothing."""
    keys = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    return index.join(small(keys, BROADCAST_KEYS), "key", "left_semi")


def delivered(pairs: DataFrame, load: Callable[[DataFrame], DataFrame], same: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """Pairs (a, b) whose payloads are ``same``.

    ``load`` gives (node, payload array<long>) of the nodes it is handed.  Each b's payload goes
    to its a, in slices of about ``SLICE`` pairs, so a hub is as many groups as it needs.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("n"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).alias("slice"))
    own = sizes.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"))
    rows, n_rows = packed(dealt.unionByName(own))
    few = F.broadcast if n_rows <= BROADCAST_ROWS else (lambda df: df)
    payloads = load(few(rows.select(F.col("b").alias("node")).distinct()))

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b").to_pylist()
        held = [x.values.to_numpy() for x in table.column("payload")]
        hub = held[b.index(a)]
        near = [name for name, x in zip(b, held, strict=True) if name != a and same(hub, x)]
        return pa.table({"a": pa.array([a] * len(near), pa.int64()), "b": pa.array(near, pa.int64())})

    met = payloads.withColumnRenamed("node", "b").join(few(rows), "b")
    return met.groupBy("a", "slice").applyInArrow(compare, "a long, b long")


def link_rounds(
    index: DataFrame,
    close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    load: Callable[[DataFrame], DataFrame],
    same: Callable[[np.ndarray, np.ndarray], bool],
    crowd: int | None = None,
) -> DataFrame:
    """(a, b): verified links that connect all nodes of ``index`` that candidate pairs connect.

    ``index`` holds (part, key, node, probe), or all but part, and what ``close`` reads of both
    sides; two probes are no candidates.  Its rows are distinct and the same when read again.
    Where most keys hold one node, hand in its ``meeting`` rows.  ``crowd`` stands in for ``CROWD``.
    """
    on = [c for c in ("part", "key") if c in index.columns]
    cols = [c for c in index.columns if c not in on]

    def side(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in (*cols, *more)])

    def named(s: str) -> Callable[[str], Column]:
        return lambda c: F.col(f"{c}_{s}")

    def candidates(met: DataFrame) -> DataFrame:
        return met.where(near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    most, mark = CROWD if crowd is None else crowd, F.xxhash64("node")
    near = close(named("a"), named("b")) & (F.col("node_a") != F.col("node_b"))
    stars = index.where("not probe").groupBy(*on).agg(*[F.min_by(c, mark).alias(c) for c in cols])
    pairs, _ = packed(candidates(side(stars, "a").join(side(index, "b"), on)))
    edges, _ = packed(pairs.limit(0))
    comps = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tried = pairs.select(F.col("a").alias("lo"), F.col("b").alias("hi"))

    def rooted(df: DataFrame, *nodes: str) -> DataFrame:
        for node in nodes:
            df = df.join(comps.select(F.col("node").alias(node), F.col("component").alias(f"root_{node}")), node, "left").withColumn(f"root_{node}", F.coalesce(f"root_{node}", node))
        return df

    def settle(left: DataFrame) -> DataFrame:
        """All links so far and those among the pairs ``left``, but for pairs that they connect already."""
        nonlocal edges, comps
        most = START
        while True:
            rows = rooted(left, "a", "b").where("root_a <> root_b").withColumn("class", F.greatest("root_a", "root_b"))
            rows, n_rows = packed(rows.select("a", "b", "class", F.xxhash64("a", "b").alias("mark")))
            if n_rows == 0:
                return edges
            sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
            chosen, n_chosen = packed(rows.join(sizes, "class").where(F.pmod("mark", F.lit(1 << 20)) * F.col("n") < F.lit(most << 20)).select("a", "b"))
            edges, _ = packed(edges.unionByName(delivered(chosen, load, same)))
            comps = small(connected_components(edges))
            if n_chosen == n_rows:
                return edges
            left, most = rows.select("a", "b").join(chosen, ["a", "b"], "left_anti"), most * MORE

    def settle_new(met: DataFrame) -> None:
        """All links among the candidates ``met`` that no round has had before."""
        nonlocal tried
        new = candidates(met).join(tried, (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi")), "left_anti")
        new, n_new = packed(new)
        if n_new:
            tried = tried.unionByName(new.select(F.col("a").alias("lo"), F.col("b").alias("hi")))
            settle(new)

    settle(pairs)
    keys = index.where("not probe").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    crowded, n_crowded = packed(keys.where(F.col("n") > most).select(*on))
    few = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
    thin = rooted(index.join(few, on, "left_anti") if n_crowded else index, "node").withColumnRenamed("root_node", "root")
    met = side(thin.where("not probe"), "a", "root").join(side(thin, "b", "root"), on)
    settle_new(met.where((F.col("root_a") != F.col("root_b")) & (F.col("probe_b") | (F.col("node_a") < F.col("node_b")))))
    if not n_crowded:
        return edges
    left, hubs = index.join(few, on, "left_semi"), most
    while True:
        rows = rooted(left, "node").withColumnRenamed("root_node", "root")
        classes = rows.groupBy(*on, "root").agg(F.count(F.lit(1)).alias("n"))
        keys = classes.groupBy(*on).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        keys, n_keys = packed(keys.select(*on, F.col("top.root").alias("top"), (F.col("all") - F.col("top.n")).alias("n")))
        if not n_keys:
            return edges
        outside, mark = F.col("root") != F.col("top"), F.xxhash64("node", F.lit(hubs))
        rows = rows.join(small(keys), on).withColumn("chosen", outside & (F.pmod(mark, F.lit(1 << 20)) * F.col("n") < F.lit(hubs * (1 << 20))))
        rows = stored(rows.select(*on, *cols, "root", "chosen"))
        apart = (F.col("root_a") != F.col("root_b")) & ~(F.col("probe_a") & F.col("probe_b")) & (~F.col("chosen_b") | (F.col("node_a") < F.col("node_b")))
        settle_new(side(rows.where("chosen"), "a", "root").join(side(rows, "b", "root", "chosen"), on).where(apart))
        left, hubs = rows.where("not chosen").select(*on, *cols), hubs * MORE
