"""Spanning forests and density sweeps against plain Python and the single-radius operator."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from cloudloom.operators import density, spatial, sweeps

SCHEMA = "ev int, hit_id long, x double, y double, z double"


def cloud(n, seed, evs=2):
    rng = random.Random(seed)
    rows = [(k % evs, k, *[round(rng.choice([0, 9, 20]) + rng.gauss(0, 2), 1) for _ in range(3)]) for k in range(n)]
    return rows + [(k % evs, n + k, 1.0, 1.0, 1.0) for k in range(9)]  # copies at one place


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_near_pairs_meet_once(spark):
    rows = cloud(120, 1)
    got = sorted((r.ev, r.i, r.j) for r in spatial.near_pairs(frame(spark, rows), 3.0, ["ev"]).collect())
    want = sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 3.0)
    assert got == want and len(set(got)) == len(got)


@pytest.mark.parametrize("seed", range(2))
def test_forest_equals_kruskal(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(min(a, b), max(a, b)): float(rng.randrange(8)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(140)) if a != b}.items(), key=lambda e: (e[1], e[0]))
    root = list(range(60))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    want = []
    for (a, b), w in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges], "u long, v long, w double")
    assert sorted(map(tuple, sweeps.spanning_forest(df).collect())) == sorted(want)
    assert sweeps.spanning_forest(df.limit(0)).collect() == []


@pytest.mark.parametrize("least", [1, 4])
def test_sweep_equals_single_radii(spark, least):
    points = frame(spark, cloud(150, 3))
    radii = [2.5, 1.0, 4.0, 1.7, 8.0]
    got = sweeps.dbscan_sweep(points, radii, least, ["ev"]).collect()
    assert len(got) == points.count() * len(radii)
    for r in radii:
        want = {(x.ev, x.hit_id): x.cluster for x in density.dbscan(points, r, least, ["ev"]).collect()}
        assert {(x.ev, x.hit_id): x.cluster for x in got if x.eps == r} == want
    assert {x.cluster for x in got} >= {-1, 0, 1} or least == 1


def test_edges_of_the_domain(spark):
    nan = float("nan")
    rows = [(0, 1, nan, 0.0, 0.0), (0, 2, None, 0.0, 0.0), (0, 3, 0.0, 0.0, 0.0), (0, 4, float("inf"), 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)]
    got = sweeps.dbscan_sweep(frame(spark, rows), [1.0, 1.0], 2, ["ev"]).collect()
    assert sorted(x.hit_id for x in got) == [1, 2, 3, 4, 5] and {x.cluster for x in got} == {-1}
    assert sweeps.dbscan_sweep(frame(spark, []), [1.0, 2.0], 2, ["ev"]).collect() == []
