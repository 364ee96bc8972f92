"""The chain of relations on planted events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cloudloom.plans import relations
from cloudloom.plans.config import ChainConfig
from cloudloom.sources.synthetic import crossing_tracks, event, line


def planted(spark):
    rng = np.random.default_rng(5)
    broken = event([(np.concatenate([line((2, 10, 10), (44, 10, 10), 200, 0.2, rng), line((56, 10, 10), (98, 10, 10), 200, 0.2, rng)]), 0), (rng.normal((20, 60, 60), 1.5, (60, 3)), 1), (rng.normal((20, 64.5, 60), 0.2, (4, 3)), 1)], event_id=2)
    frames = [crossing_tracks(0, 0), crossing_tracks(1, 1), broken]
    hits = spark.createDataFrame(pd.concat(frames)).withColumns({"g": F.col("truth_t0").cast("long"), "ev": F.col("event_id").cast("int"), "tpc": F.col("tpc").cast("int")})
    return hits.select("ev", "hit_id", "x", "y", "z", "e", "tpc", "g").repartition(4)


def test_chain_on_planted_events(spark):
    hits = planted(spark)
    labels = relations.chain(hits, ["ev"], config=ChainConfig.of(leftover_min=3)).cache()
    assert labels.count() == hits.count() and labels.select("ev", "hit_id").distinct().count() == hits.count()
    by = {(r.ev, r.stage): r for r in relations.stage_scores(labels, hits, ["ev"]).collect()}
    for ev in (0, 1, 2):
        last = by[ev, "fragments"]
        assert last.purity > 0.98 and last.completeness > 0.95, (ev, last)
        assert last.n_clusters <= by[ev, "segments"].n_clusters + by[ev, "leftover"].n_clusters
        assert by[ev, "stitch"].completeness > by[ev, "segments"].completeness
    kinds = labels.groupBy("ev").agg(F.count_distinct(F.when((F.col("label") >= 0) & (F.col("label") < F.col("split")), F.col("label"))).alias("tracks")).collect()
    assert {r.ev: r.tracks for r in kinds} == {0: 2, 1: 2, 2: 1}
    labels.unpersist()


def test_empty_and_without_segments(spark):
    hits = planted(spark)
    assert relations.chain(hits.limit(0), ["ev"]).collect() == []
    few = hits.where("hit_id % 97 = 0 and ev = 0")
    assert {r.label for r in relations.chain(few, ["ev"]).collect()} == {-1}
