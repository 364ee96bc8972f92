"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=100, positives=5, negatives_=10, low=30, high=90):
    """Plain Python over (vec_id, label, vector) rows; labels are taken as they stand."""
    kept = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, g, v) in enumerate(kept):
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, h) for m, (i, h, w) in enumerate(kept) if m != k), key=lambda r: r[:2])
        for p, pid, _ in [r for r in scored if r[2] == g][:positives]:
            fit = [(n, i) for n, i, h in scored if h != g and low * -p <= 100 * -n <= high * -p][:negatives_]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    clash = {c: F.lit("x") for c in ("v", "uid", "far", "cell", "ring", "query", "slot", "score", "rank")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    return sorted(map(tuple, negatives.hard_negatives(negatives.quantised(df), **options).collect()))


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 4 + 0.2 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    return [(int(i), int(g), v.tolist()) for i, g, v in zip(range(n), rng.integers(0, 4, n), x)]


@pytest.mark.parametrize("dim,clusters", [(8, 0), (16, 12)])
def test_equals_brute_force(spark, dim, clusters, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(negatives, "BLOCK", 40)
    rows = vectors(1200, dim, 3, clusters)
    assert mined(spark, rows, every=10) == brute(rows, 10)


def test_ties_repeats_nulls_and_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 20)
    rows = vectors(300, 6, 4)
    same = rows[7][2]
    rows += [(1000 + i, i % 3, same) for i in range(150)]  # a third of all rows are one vector
    rows += [(100, 1, same), (100, 1, same), (200, 2, rows[200][2]), (5, 0, [0.5])]
    rows += [(None, 1, same), (2000, None, same), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")]), (2004, 1, [float("inf")]), (2005, 3, []), (-100, 1, same)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    for scale in (3e3, 3e6):
        rows = [(i, i % 2, (rng.normal(size=4) * scale).astype("f4").tolist()) for i in range(0, 400, 4)]
        assert mined(spark, rows) == brute(rows)


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, vectors(5, 4, 1)[1:]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_pivots_spare_rows_of_other_clusters():
    rows = vectors(4000, 16, 5, 20)
    x = np.floor(256 * np.array([r[2] for r in rows]).astype("f8"))
    most = float((x * x).sum(1).max())
    space = negatives.Space(16, most, negatives.choose_pivots(x[::10], most))
    q = negatives.Queries(np.arange(40), np.array([r[1] for r in rows[:40]]), x[:40], np.full((40, 1), int(0.8 * most)), np.full((40, 1), negatives.MOST), 5, True, space)
    far = space.distances(x)
    order = np.lexsort((far.min(1), far.argmin(1)))
    cell = far.argmin(1)[order]
    edges = np.flatnonzero(np.diff(cell, prepend=-1))
    for c, d in zip(edges, [*edges[1:], len(x)]):
        own = order[c:d]
        who, a, b = q.survivors(far[own], cell[c:d], far[own].min(1))
        score = q.x @ x[own].T
        hit = np.argwhere(score >= 0.8 * most)
        assert all(i in who and a <= r < b for i, r in hit)  # nothing in the range is passed over
        q.add(own, own, np.array([rows[r][1] for r in own]), x[own], who)
    assert q.scored < 0.3 * 40 * len(x)


def test_query_equals_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/embeddings.parquet"):
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{p}'")
    want = con.execute(negatives.OP11_SQL).fetchall()
    got = negatives.op11_hard_negatives(spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
