"""Soft assignment of clusters to slots by annealed message passing over the link graph.

Each cluster has a field, its log preference for every slot, and each link a strength that favours equal slots (a Potts
model).  A message along a link is what its sender believes without what the receiver told it, so nobody hears its own
voice; beliefs are the field plus all messages.  All clusters update together, messages are damped, and the
inverse temperature rises step by step, from beliefs that spread over slots to such that have settled.

A round adds messages up by receiver and slot (combined map-side, so a hub is no single task's work) and joins the
sums back to the links; both messages of a link stand in one row, so a belief without the receiver's part is a
subtraction.  Each round is written, and a temperature step ends when no message changes by more than
``tolerance``.  On a tree the result is the exact marginals once the rounds reach across it (tested); on
graphs with cycles it is an approximation whose last change is reported.

The light terms of the field are not part of this library: whoever has them adds them to ``field``.

Defined results: a cluster without links keeps its field's distribution; slots missing from a cluster's field cannot be its;
links to clusters without a field, of a cluster to itself and of null strength are left out, repeated links add up; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as data_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.moments import pinned
from cloudloom.operators.graph import stored

#: Stands for the logarithm of zero.
NEVER = -1e9


@dataclass
class Annealed:
    """Beliefs (keys, node, slot, p) and, for each round, the inverse temperature and the largest change of a message."""

    beliefs: DataFrame
    rounds: list[tuple[float, float]] = data_field(default_factory=list)

    @property
    def residual(self) -> float:
        return self.rounds[-1][1] if self.rounds else 0.0


def _shares(df: DataFrame, logs: dict[str, Column]) -> DataFrame:
    """``df`` with probabilities of arrays of logs, step by step: an array is not computed anew for each of its elements."""

    def each(array: str, of: Callable[[Column, Column], Column], fixed: str) -> Column:
        return F.transform(array, lambda v: of(v, F.col(fixed)))

    df = pinned(df, {f"_l_{k}": v for k, v in logs.items()})
    df = pinned(df, {f"_t_{k}": F.array_max(f"_l_{k}") for k in logs})
    df = pinned(df, {f"_u_{k}": each(f"_l_{k}", lambda v, top: F.exp(v - top), f"_t_{k}") for k in logs})
    df = pinned(df, {f"_s_{k}": F.aggregate(f"_u_{k}", F.lit(0.0), lambda s, x: s + x) for k in logs})
    df = pinned(df, {k: each(f"_u_{k}", lambda v, total: v / total, f"_s_{k}") for k in logs})
    return df.drop(*[f"_{x}_{k}" for x in "ltus" for k in logs])


def anneal(
    fields: DataFrame, links: DataFrame, keys: list[str], betas: tuple[float, ...] = (0.3, 0.6, 1.2, 2.5, 5.0), damping: float = 0.3, tolerance: float = 1e-6, max_rounds: int = 30, strength: float = 1.0
) -> Annealed:
    """Beliefs after the last of ``betas``; ``fields`` has (keys, node, slot, field), ``links`` (keys, a, b, j).

    ``max_rounds`` bounds each temperature step; a message is ``damping`` of the old and the rest of the new one.
    """
    slots = fields.select(*keys, "slot").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    own = fields.where("field is not null").groupBy(*keys, "node").agg(F.map_from_entries(F.collect_list(F.struct("slot", "field"))).alias("_f"))
    nodes = stored(own.join(slots, keys).select(*keys, "node", "slots", F.transform("slots", lambda s: F.coalesce(F.col("_f")[s], F.lit(NEVER))).alias("own")))
    pairs = links.where("a <> b and j is not null").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("j").alias("j"))
    for s in "ab":
        pairs = pairs.join(nodes.select(*keys, F.col("node").alias(s), F.size("slots").alias(f"_{s}")), [*keys, s])
    even = F.array_repeat(-F.log(F.col("_a").cast("double")), F.col("_a"))
    edges = stored(pairs.select(*keys, "a", "b", "j", even.alias("ab"), even.alias("ba")))
    rounds: list[tuple[float, float]] = []

    def beliefs(beta: float) -> DataFrame:
        """(keys, node, belief): field and messages of each node, as logs."""
        heard = edges.select(*keys, F.col("b").alias("node"), F.posexplode("ab").alias("k", "m")).unionByName(edges.select(*keys, F.col("a").alias("node"), F.posexplode("ba").alias("k", "m")))
        sums = heard.groupBy(*keys, "node", "k").agg(F.sum("m").alias("m")).groupBy(*keys, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("heard"))
        all_ = nodes.join(sums, [*keys, "node"], "left")
        field_ = F.transform("own", lambda v: v * beta)
        return all_.select(*keys, "node", "slots", F.when(F.col("heard").isNull(), field_).otherwise(F.zip_with(field_, F.col("heard"), lambda x, y: x + y)).alias("belief"))

    for beta in betas:
        for _ in range(max_rounds):
            now = beliefs(beta).drop("slots")
            met = edges
            for s in "ab":
                met = met.join(now.withColumnsRenamed({"node": s, "belief": f"_{s}"}), [*keys, s])
            # What each end believes without the other's message, and the Potts link's message from that.
            met = _shares(met, {"_ca": F.zip_with("_a", "ba", lambda x, m: x - m), "_cb": F.zip_with("_b", "ab", lambda x, m: x - m)})
            met = pinned(met, {"_w": F.expm1(F.col("j") * (beta * strength)), "_k": F.size("_a").cast("double")})
            met = pinned(met, {f"_n{c}": F.transform(f"_c{c}", lambda h: F.log((1 + F.col("_w") * h) / (F.col("_k") + F.col("_w")))) for c in "ab"})
            mix = lambda old, new: F.zip_with(old, new, lambda x, y: damping * x + (1 - damping) * y)
            met = pinned(met, {"_ab": mix("ab", "_na"), "_ba": mix("ba", "_nb")})
            change = [F.array_max(F.zip_with(c, f"_{c}", lambda x, y: F.abs(x - y))) for c in ("ab", "ba")]
            next_ = stored(met.select(*keys, "a", "b", "j", F.col("_ab").alias("ab"), F.col("_ba").alias("ba"), F.greatest(*change).alias("change")))
            moved = next_.agg(F.max("change")).first()[0]
            if moved is None:
                break
            edges = next_.drop("change")
            rounds.append((beta, float(moved)))
            if moved <= tolerance:
                break
    last = betas[-1]
    spread = _shares(beliefs(last), {"p": F.col("belief")}).select(*keys, "node", F.explode(F.arrays_zip("slots", "p")).alias("_s"))
    return Annealed(spread.select(*keys, "node", F.col("_s.slots").alias("slot"), F.col("_s.p").alias("p")).where("p > 0"), rounds)


def hardened(beliefs: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, node, slot, p): the likeliest slot of each cluster, null where it has no more than ``least``; ties go to the smaller slot."""
    best = beliefs.groupBy(*keys, "node").agg(F.max(F.struct("p", (-F.col("slot")).alias("minus"))).alias("b"))
    return best.select(*keys, "node", F.when(F.col("b.p") > least, -F.col("b.minus")).alias("slot"), F.col("b.p").alias("p"))
