"""The clustering chain over tables: events in parallel, one kernel call an event."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import kernels
from cloudloom.operators.event import Event
from cloudloom.plans.config import ChainConfig

STAGES = ("segments", "build", "rejoin", "pinpoint", "refine", "two_track", "fragments")


def _seed(key, base: int) -> int:
    return zlib.crc32(repr([str(k) for k in key]).encode()) % 100_000 + base


def cluster(hits: DataFrame, keys: list[str], config: ChainConfig | None = None) -> DataFrame:
    """(keys, hit_id, label, split, kind) and the labels after each stage.

    An event is a few megabytes and is never split, so it is one group; thousands of them keep a
    cluster busy.  Hits are ordered by hit_id, and the random numbers of an event depend on its
    key alone: partitions do not matter.
    """
    cfg = config or ChainConfig.of()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hit_id", kind="stable")
        event = Event(pdf[["x", "y", "z"]].to_numpy(float), pdf["e"].to_numpy(float), pdf["tpc"].to_numpy(), cfg, _seed(key, cfg.seed))
        event.run()
        out = pdf[[*keys, "hit_id"]].copy()
        out["label"] = event.labels
        out["split"] = event.split
        out["kind"] = [("noise" if k < 0 else event.kinds.get(int(k), "track") if k < event.split else "blob") for k in event.labels]
        last = np.full(len(pdf), -1, np.int64)
        for name in STAGES:
            last = event.stages.get(name, last)
            out[f"at_{name}"] = last
        return out

    types = dict(hits.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"hit_id {types['hit_id']}", "label long, split long, kind string", *[f"at_{s} long" for s in STAGES]])
    return hits.select(*keys, "hit_id", "x", "y", "z", "e", "tpc").groupBy(*keys).applyInPandas(run, schema)


def segments(hits: DataFrame, keys: list[str], config: ChainConfig | None = None) -> DataFrame:
    """(keys, tpc, hit_id, segment, source) of line-like groups, cell by cell; hits of none are left out."""
    cfg = config or ChainConfig.of()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hit_id", kind="stable")
        found = kernels.cell_segments(pdf[["x", "y", "z"]].to_numpy(float), cfg, _seed(key, cfg.seed))
        parts = [pdf.iloc[m][[*keys, "tpc", "hit_id"]].assign(segment=n, source=s) for n, (m, s) in enumerate(found)]
        return pd.concat(parts) if parts else pdf.iloc[:0][[*keys, "tpc", "hit_id"]].assign(segment=0, source="")

    types = dict(hits.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in [*keys, "tpc", "hit_id"]]) + ", segment long, source string"
    return hits.select(*keys, "tpc", "hit_id", "x", "y", "z").groupBy(*keys, "tpc").applyInPandas(run, schema)


def two_line_split(hits: DataFrame, keys: list[str], iters: int = 60, inlier: float = 1.2) -> DataFrame:
    """(keys, hit_id, side, rms): the best partition of each group of points into two lines."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hit_id", kind="stable")
        p = pdf[["x", "y", "z"]].to_numpy(float)
        best = kernels.two_lines(p, iters, inlier, np.random.default_rng(_seed(key, 0))) if len(p) >= 6 else None
        side, rms = best if best is not None else (np.zeros(len(p), bool), float("nan"))
        return pdf[[*keys, "hit_id"]].assign(side=side.astype(int), rms=rms)

    types = dict(hits.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in [*keys, "hit_id"]]) + ", side int, rms double"
    return hits.select(*keys, "hit_id", "x", "y", "z").groupBy(*keys).applyInPandas(run, schema)


def evaluate(hits: DataFrame, labels: DataFrame, keys: list[str], tick_gap: float = 3.0) -> DataFrame:
    """Purity and completeness of chain labels against truth groups chained from ``truth_t0``."""
    from cloudloom.operators.metrics import purity_completeness
    from cloudloom.operators.windows import truth_groups

    truth = truth_groups(hits.select(*keys, "hit_id", "e", "truth_t0"), keys, "truth_t0", tick_gap)
    return purity_completeness(truth.join(labels.select(*keys, "hit_id", "label"), [*keys, "hit_id"]), keys)


def label_info(hits: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, cells and kind of each label, from the hits themselves."""
    joined = hits.join(labels.select(*keys, "hit_id", "label", "split", "kind"), [*keys, "hit_id"])
    out = joined.where("label >= 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_set("tpc")).alias("cells"), F.sum("e").alias("e"), F.max("kind").alias("kind"), F.max("split").alias("split"))
    return out.withColumn("backbone", F.col("label") < F.col("split")).drop("split")
