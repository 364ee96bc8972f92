"""Lineage, exact quantiles and vertices on planted cases and against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import quantiles
from cloudloom.operators import lineage, vertices


def test_kinds_of_lineage(spark):
    # (before, after, hits) for each kind; noise is -1.
    planted = {"kept": [(1, 1, 5)], "peeled": [(2, 2, 5), (2, -1, 3)], "fed": [(3, 3, 5), (-1, 3, 2)], "split": [(4, 4, 6), (4, 40, 2)], "merged": [(5, 5, 4), (6, 5, 3)]}
    planted |= {"mixed": [(7, 7, 4), (7, 70, 2), (8, 70, 3)], "lost": [(9, -1, 4)], "new": [(-1, 90, 4)]}
    rows = [(0, h, old, new, 2.0) for h, (old, new) in enumerate([(o, n) for v in planted.values() for o, n, k in v for _ in range(k)])] + [(0, 999, -1, -1, 1.0)]
    df = spark.createDataFrame(rows, "ev int, hit_id long, old long, new long, e double")
    before, after = df.select("ev", "hit_id", F.col("old").alias("label"), "e"), df.select("ev", "hit_id", F.col("new").alias("label"))
    table = lineage.overlaps(before, after.where("hit_id <> 0"), ["ev", "hit_id"], ["ev"])  # the first hit is of one side only
    got = {r.kind: r for r in lineage.lineage(table, ["ev"]).collect()}
    assert set(got) == set(planted) - {"kept"} and got["peeled"].e_lost in (2.0, 6.0)
    got = {r.kind: r for r in lineage.lineage(lineage.overlaps(before, after, ["ev", "hit_id"], ["ev"]), ["ev"]).collect()}
    assert set(got) == set(planted)
    for kind, v in planted.items():
        r = got[kind]
        assert (r.e_kept, r.e_lost, r.e_gained) == tuple(2.0 * sum(k for o, n, k in v if c(o, n)) for c in (lambda o, n: o >= 0 and n >= 0, lambda o, n: n < 0, lambda o, n: o < 0))
        assert (r.olds, r.news, r.n) == (len({o for o, _, _ in v if o >= 0}), len({n for _, n, _ in v if n >= 0}), sum(k for *_, k in v))
    assert got["merged"].component == 5 and got["new"].component == 90
    assert lineage.lineage(table.limit(0), ["ev"]).collect() == []


def test_separation_verdicts(spark):
    rows = [(0, 1, 1, 7, 5.0), (0, 1, 2, 8, 3.0), (0, 1, 2, 7, 1.0), (0, 1, 3, 7, 2.0), (0, 1, -1, None, 4.0), (0, 4, 5, 7, 1.0), (0, 4, 6, 8, 2.0), (0, -1, 9, 7, 1.0)]
    got = {(r.old, r.new): (r.e_new, r.e_foreign, r.verdict) for r in lineage.separation_audit(spark.createDataFrame(rows, "ev int, old long, new long, g long, e double"), ["ev"]).collect()}
    assert got == {(1, 2): (4.0, 3.0, "separated"), (1, 3): (2.0, 0.0, "broke_same"), (1, None): (4.0, 0.0, "no_truth"), (4, 5): (1.0, 1.0, "separated")}


@pytest.mark.parametrize("few", [1, 40])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=900), 1: np.repeat([1.0, 2.0, 5.0], [300, 500, 7]), 2: rng.integers(0, 9, 800).astype(float), 3: rng.normal(size=20), 4: np.array([4.0] * 700), 5: 10.0 ** rng.uniform(-9, 9, 600)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(k, v) for k in (0, 3, 6) for v in (None, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", shares, large=100, bins=8, few=few).collect()}
    for k, vs in groups.items():
        assert [got[k][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(vs, shares), rel=1e-12)
    assert got[6].q0 is None and len(got) == 7
    whole = quantiles.exact_quantiles(df.where("k = 0"), [], "v", [0.5], large=100, bins=8, few=few).collect()
    assert len(whole) == 1 and whole[0].q0 == pytest.approx(np.quantile(groups[0], 0.5))
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", shares).collect() == []


def test_vertices(spark):
    def line(name, a, b):
        a, b = np.array(a, float), np.array(b, float)
        d = (b - a) / np.linalg.norm(b - a)
        return (0, name, *((a + b) / 2).tolist(), *d.tolist(), *a.tolist(), *b.tolist())

    rows = [line(1, (0, 0, 0), (50, 0, 0)), line(2, (1, 0, 0), (0, 50, 0)), line(3, (0, 0, 1), (0, -20, 60)), line(4, (50, 2, 0), (90, 2, 40)), line(5, (200, 0, 0), (230, 0, 0)), line(6, (300, 0, 0), (302, 0, 0))]
    rows += [line(7, (400, 0, 0), (450, 0, 0)), line(8, (400, 0, 6), (400, 50, 6))]  # ends meet, lines pass each other
    tracks = spark.createDataFrame(rows, "ev int, id long, cx double, cy double, cz double, dx double, dy double, dz double, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.id: (r.vertex, r.type) for r in vertices.assign_vertices(tracks, ["ev"], least=2).collect()}
    assert got == {1: (0, "shower"), 2: (0, "shower"), 3: (0, "shower"), 4: (1, "vertex"), 5: (2, "track"), 6: (3, "track"), 7: (4, "track"), 8: (5, "track")}
    assert vertices.assign_vertices(tracks.limit(0), ["ev"]).collect() == []
