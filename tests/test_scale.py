"""What crowded or large groups ask of memory and rows, beside equality with plain ways."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from cloudloom.operators import kernels


def brute(p, r):
    """Least reachable point of every point, by all pairs."""
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= r
    root = np.arange(len(p))
    while True:
        new = np.where(near, root[None], len(p)).min(1)
        if np.array_equal(new, root):
            return root
        root = new


@pytest.mark.parametrize("most", [500, 4_000_000])
def test_kernels_equal_all_pairs_in_any_blocks(monkeypatch, most):
    monkeypatch.setattr(kernels, "MOST", most)
    rng = np.random.default_rng(4)
    for n, wide in ((1, 1), (40, 2), (400, 6), (600, 1)):
        p = rng.normal(size=(n, 3)) * wide
        p[: n // 4] = p[n - n // 4 :]  # points at one place
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        for r, least in ((0.7, 1), (1.0, 3), (2.0, 9)):
            assert np.array_equal(kernels.linked(p, r), brute(p, r))
            core = (d <= r).sum(1) >= least
            want, own = np.full(n, -1), np.flatnonzero(core)
            if len(own):
                want[own] = np.unique(brute(p[own], r), return_inverse=True)[1]
            for k in np.flatnonzero(~core):
                near = want[own[d[k, own] <= r]]
                want[k] = near.min() if len(near) else -1
            assert np.array_equal(kernels.dbscan(p, r, least), want)


def test_a_crowded_event_holds_no_pairs():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(6000, 3))  # 36 million pairs within 12
    tracemalloc.start()
    assert (kernels.dbscan(p, 12.0, 3) == 0).all() and (kernels.linked(p, 12.0) == 0).all() and kernels.scale(p, 8) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6


def test_equal_energies_in_any_order_go_to_the_least_group(spark):
    from cloudloom.operators import metrics

    rows = [(0, 1, 7, e) for e in (0.1, 0.2, 0.3)] + [(0, 1, 5, e) for e in (0.3, 0.2, 0.1)]  # as doubles 0.6000000000000001 and 0.6
    rows += [(0, 2, 5, 0.6), (0, 2, 7, 0.6000001)]
    for part in (rows, rows[::-1]):
        hits = spark.createDataFrame(part, "ev int, label long, g long, e double").coalesce(1)
        got = {r.label: (r.dom, round(r.e_dom, 6), round(r.e_foreign, 6)) for r in metrics.dominant(hits, ["ev"]).collect()}
        assert got[1] == (5, 0.6, 0.6) and got[2][0] == 7


def test_contacts_look_at_every_point(spark):
    from cloudloom.operators import links

    rng = np.random.default_rng(6)
    at = {1: (0, 0, 0), 2: (3, 0, 0), 3: (40, 0, 0)}  # more points than were sampled; the third cluster is far off
    rows = [(0, k, k * 1000 + n, *map(float, p)) for k, c in at.items() for n, p in enumerate(np.round(rng.normal(size=(350, 3)), 1) + c)]
    hits = spark.createDataFrame(rows, "ev int, label long, hit_id long, x double, y double, z double")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 3)], "ev int, a long, b long")
    for r in links.contacts(pairs, hits, ["ev"]).collect():
        a, b = ([x for x in rows if x[1] == k] for k in (r.a, r.b))
        d = np.sqrt(((np.array([x[3:] for x in a])[:, None] - np.array([x[3:] for x in b])[None]) ** 2).sum(2))
        assert r.d_min == pytest.approx(d.min()) and r.n3 == (d.min(1) <= 3).sum()
        assert np.linalg.norm(np.subtract((r.pax, r.pay, r.paz), (r.pbx, r.pby, r.pbz))) == pytest.approx(d.min())


def test_crowded_places_cost_no_pairs(spark):
    import os

    from cloudloom.operators import density, graph, sweeps

    folder = graph.checkpoint_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    rng = np.random.default_rng(7)
    rows = [(n, *map(float, p)) for n, p in enumerate(rng.normal(size=(3000, 3)))] + [(3000, 90.0, 0.0, 0.0), (3001, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "hit_id long, x double, y double, z double").selectExpr("0 AS ev", "*")
    before = size()
    made = sweeps.dbscan_sweep(df, [12.0, 14.0], 4, ["ev"]).collect()  # 4.5 million pairs at either radius
    assert {(r.cluster, r.hit_id < 3000) for r in made} == {(0, True), (-1, False)} and len(made) == 2 * len(rows)
    assert size() - before < 4e6
    parts = {r.hit_id: (r.component, r["size"]) for r in density.radius_components(df, 12.0, ["ev"]).collect()}
    assert parts[0] == parts[2999] == (0, 3000) and parts[3000] == (1, 1) and parts[3001] == (2, 1)


@pytest.mark.parametrize("name", ["dominant_group", "overmerged_hits"])
def test_energies_that_nearly_tie_are_summed_in_the_order_of_rows(spark, tmp_path, name):
    import duckdb

    from cloudloom.plans.registry import QUERIES, SQL

    hour = "timestamp '2024-01-01 00:00:00'"
    tied = [("view", e) for e in (0.3, 0.2, 0.1)] + [("click", e) for e in (0.1, 0.2, 0.3)]  # 0.6 for v, 0.6000000000000001 for c
    users = {1: tied, 2: tied[::-1], 3: [("view", 0.5), ("view", 0.1), ("click", 0.6)], 4: tied + [("error", 9.0)], 5: [("view", 0.0), ("click", 0.0)]}
    rows = [(user, *r) for user, rs in users.items() for r in rs]
    values = ", ".join(f"({k}, {hour}, {user}, '{kind}', {e}::double)" for k, (user, kind, e) in enumerate((*rows, *[(9, "view", 1.0)] * 3), 12))
    (tmp_path / "events.parquet").mkdir()
    con = duckdb.connect()
    con.execute(f"set threads = 1; create table events as select *, '{{}}' as props from (values {values}) v(event_id, ts, user_id, event_type, value)")
    con.execute("update events set event_id = event_id * 11 + 1")
    for file, part in (("a", "event_id <= 220"), ("b", "event_id > 220")):  # ids fall within a file
        con.execute(f"copy (select * replace (999999 - event_id as event_id) from events where {part} order by events.event_id) to '{tmp_path}/events.parquet/{file}.parquet' (format parquet)")
    con.execute(f"drop table events; create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
