"""Neighbours, graphs, density and windows against brute force; kernels and the chain on planted events."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import density, graph, kernels, metrics, spatial, stages, windows
from cloudloom.operators.event import Event
from cloudloom.plans import chain
from cloudloom.plans.config import ChainConfig
from cloudloom.sources import readers
from cloudloom.sources.synthetic import crossing_tracks, event, line


def points(spark, p, **more):
    rows = [(0, i, *map(float, q), *(float(v[i]) for v in more.values())) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, "ev int, hit_id long, x double, y double, z double" + "".join(f", {k} double" for k in more))


def sequential_dbscan(p, eps, least):
    d = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core, out, k = d.sum(1) >= least, np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and out[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if out[j] < 0:
                    out[j] = k
                    if core[j]:
                        todo += np.flatnonzero(d[j] & (out < 0)).tolist()
            k += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dbscan_and_components(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, 12, (120, 3)), 1)
    want = sequential_dbscan(p, 2.0, 4)
    assert kernels.dbscan(p, 2.0, 4).tolist() == want.tolist()
    got = {r.hit_id: r.cluster for r in density.dbscan(points(spark, p), 2.0, 4, ["ev"]).collect()}
    assert [got[i] for i in range(len(p))] == want.tolist()
    i, j, _ = kernels.near_pairs(p, p, 2.0)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(d <= 2.0)), strict=True))
    pairs = {(r.i, r.j) for r in spatial.eps_pairs(points(spark, p), 2.0, ["ev"]).collect()}
    assert pairs == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


@pytest.mark.parametrize("one_task", [-1, graph.ONE_TASK])
def test_components_of_chains_and_hubs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(5, 5), (7, 8), (8, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_sequential_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(0, int(a), int(b), float(round(s, 2))) for a, b, s in zip(rng.integers(0, 15, 50), rng.integers(20, 35, 50), rng.random(50), strict=True)]
    edges = list({e[:3]: e for e in edges}.values())
    used, want = set(), set()
    for _, a, b, s in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame(edges, "ev int, a long, b long, score double")
    assert {(r.a, r.b) for r in graph.greedy_exclusive(df, ["ev"]).collect()} == want


def test_window_boundaries(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([0.0, 3.0, 6.0001, float("nan"), None, 9.0, float("inf")])], "ev int, hit_id long, t0 double")
    got = {r.hit_id: r.g for r in windows.truth_groups(df, ["ev"]).collect()}
    assert [got[k] for k in range(7)] == [0, 0, 1, -1, -1, 1, -1]
    v = [1.0, 1.1, 1.2, 5.0, 5.1, 5.2]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(v)], "ev int, hit_id long, v double")
    o = windows.otsu_split(df, ["ev"], "v").first()
    assert (o.n_low, o.n_high) == (3, 3) and o.threshold == pytest.approx(kernels.otsu(np.array(v))[0])


def test_fragment_boundary_is_inclusive(spark):
    p = np.concatenate([np.zeros((12, 3)), [[3.0, 0, 0]], [[0, 3.0001, 0]]])
    hits = points(spark, p, label=[0] * 12 + [1, 2], e=[1] * 14).withColumn("label", F.col("label").cast("long"))
    out = {r.hit_id: r.label for r in stages.absorb_fragments(hits, ["ev"]).collect()}
    assert out[12] == 0 and out[13] == 2


def test_scores_of_a_known_labelling(spark):
    rows = [(0, 0, 0, 5.0), (0, 0, 1, 1.0), (0, 1, 1, 4.0), (0, -1, 1, 9.0), (0, 1, -1, 9.0)]
    r = metrics.purity_completeness(spark.createDataFrame(rows, "ev int, label long, g long, e double"), ["ev"]).first()
    assert (r.e_total, r.n_clusters, r.n_groups) == (10.0, 2, 2) and r.purity == pytest.approx(0.9) and r.completeness == pytest.approx(0.9)


def test_planted_lines_are_found():
    rng = np.random.default_rng(1)
    a, b = line((0, 0, 0), (40, 10, 5), 200, 0.3, rng), line((0, 30, 0), (40, 35, 40), 200, 0.3, rng)
    p = np.concatenate((a, b, rng.uniform(0, 40, (40, 3))))
    labels = kernels.find_lines(p, ChainConfig.of(rss_limit=0.0), 0)
    assert (labels[:200] == np.bincount(labels[:200][labels[:200] >= 0]).argmax()).mean() > 0.9
    assert (labels[200:400] == np.bincount(labels[200:400][labels[200:400] >= 0]).argmax()).mean() > 0.9


def test_parallel_lines_are_split():
    rng = np.random.default_rng(2)
    p = np.concatenate((line((0, 0, 0), (60, 0, 0), 120, 0.2, rng), line((0, 5, 0), (60, 5, 0), 120, 0.2, rng)))
    parts = kernels.split_segment(p, ChainConfig.of())
    assert sorted(map(len, parts)) == [120, 120] and {tuple(sorted(set((k < 120).tolist()))) for k in parts} == {(True,), (False,)}


def test_two_lines_of_a_crossing():
    rng = np.random.default_rng(3)
    p = np.concatenate((line((0, 0, 0), (30, 0, 0), 60, 0.2, rng), line((0, 0, 0), (25, 12, 0), 60, 0.2, rng)))
    side, rms = kernels.two_lines(p, 60, 1.2, np.random.default_rng(0))
    assert rms < 0.5 and max(side[:60].mean(), 1 - side[:60].mean()) > 0.85


def test_rejoin_needs_a_bridge():
    rng = np.random.default_rng(4)
    a, b = line((-30, 0, 0), (30, 0, 0), 150, 0.2, rng), line((50, 0, 0), (110, 0, 0), 150, 0.2, rng)
    box = rng.uniform((-30, -30, -30), (110, 30, 30), (60, 3))
    bridge = line((31, 0, 0), (49, 0, 0), 60, 0.2, rng)
    for extra, joined in ((bridge, True), (np.zeros((0, 3)), False)):
        p = np.concatenate((a, b, box, extra))
        e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(), 0)
        e.labels[:150], e.labels[150:300], e.split = 0, 1, 2
        e.rejoin()
        assert (e.labels[150] == 0) == joined


def test_pinpoint_merges_a_vee():
    rng = np.random.default_rng(5)
    p = np.concatenate((line((20, 20, 20), (50, 20, 20), 120, 0.1, rng), line((20, 20, 20), (45, 45, 20), 120, 0.1, rng), rng.uniform(0, 70, (80, 3))))
    e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(), 0)
    e.labels[:120], e.labels[120:240], e.split = 0, 1, 2
    e.pinpoint()
    assert set(e.labels[:240]) == {0}


def test_refine_cuts_lumps_and_keeps_noise():
    rng = np.random.default_rng(6)
    p = np.concatenate((rng.normal(0, 0.8, (350, 3)), rng.normal((12, 0, 0), 0.8, (250, 3)), [[500.0, 0, 0]]))
    e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(), 0)
    e.labels[:600], e.split = 0, 0
    e.refine()
    assert e.labels[0] == 0 and len(set(e.labels[350:600].tolist()) - {0}) >= 1 and e.labels[600] == -1


def test_intersections_even_out_a_crossing():
    rng = np.random.default_rng(8)
    a, b = line((0, 0, 0), (60, 0, 0), 240, 0.3, rng), line((30, -30, 0), (30, 30, 0), 240, 0.3, rng)
    p = np.concatenate((a, b))
    e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(intersect=True), 0)
    truth = np.repeat([0, 1], 240)
    e.labels, e.split = truth.copy(), 2
    stolen = np.flatnonzero((truth == 1) & (np.abs(p[:, 1]) < 3))
    e.labels[stolen] = 0  # the crossing's hits all went to one track
    wrong = (e.labels != truth).sum()
    e.intersections()
    assert (e.labels != truth).sum() < wrong / 2 and set(e.labels) == {0, 1}


def test_intersections_shed_to_a_cloud():
    rng = np.random.default_rng(9)
    a, cloud = line((0, 0, 0), (80, 0, 0), 400, 0.3, rng), rng.normal((40, 2.2, 0), 0.8, (500, 3))
    p = np.concatenate((a, cloud))
    e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(intersect=True), 0)
    e.labels, e.split = np.repeat([0, 1], (400, 500)), 1
    near = 400 + np.flatnonzero(cloud[:, 1] < 1.4)
    e.labels[near] = 0
    e.intersections()
    assert (e.labels[near] == 1).sum() > 0 and (e.labels[:400] == 0).mean() > 0.97


@pytest.mark.parametrize("profile", ["adopted", "production"])
def test_chain_does_not_depend_on_partitions(spark, profile):
    import pandas as pd

    hits = spark.createDataFrame(pd.concat([crossing_tracks(s, s) for s in range(3)]))
    runs = []
    for n in (1, 4, 7):
        out = chain.cluster(hits.repartition(n), ["event_id"], ChainConfig.of(profile))
        runs.append({(r.event_id, r.hit_id): (r.label, r.kind) for r in out.collect()})
    assert runs[0] == runs[1] == runs[2]
    score = chain.evaluate(hits, out, ["event_id"]).collect()
    assert all(r.purity > 0.99 and r.completeness > 0.95 for r in score)
    info = chain.label_info(hits, out, ["event_id"]).collect()
    assert sum(r.n_hits for r in info) == sum(v[0] >= 0 for v in runs[0].values())


def test_degenerate_events():
    for p in (np.zeros((0, 3)), np.zeros((1, 3)), np.random.default_rng(0).uniform(0, 500, (60, 3))):
        e = Event(p, np.ones(len(p)), np.zeros(len(p), int), ChainConfig.of(), 0)
        e.run()
        assert (e.labels == -1).all()


def test_options_run():
    d = event([(line((2, 10, 10), (148, 40, 30), 600, 0.3, np.random.default_rng(0)), 0), (line((2, 60, 10), (148, 10, 60), 600, 0.3, np.random.default_rng(1)), 1)])
    for changes in ({"stitch": "legacy", "vertex_min": 3}, {"merge": True, "showers": True, "peel": True, "intersect": True}, {"pin_blobs": "two_phase"}, {"pin_blobs": "tracklike"}, {"pin_blobs": "tracklike_boundary", "frag_blobs_only": True}):
        e = Event(d[["x", "y", "z"]].to_numpy(), d["e"].to_numpy(), d["tpc"].to_numpy(), ChainConfig.of(**changes), 0)
        e.run()
        assert (e.labels >= 0).mean() > 0.9
    with pytest.raises(KeyError):
        ChainConfig.of(no_such_key=1)


def test_relational_merges(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate((line((0, 0, 0), (30, 0, 0), 80, 0.05, rng), line((0, 0, 0), (20, 20, 0), 80, 0.05, rng), line((100, 0, 0), (130, 0, 0), 80, 0.05, rng)))
    hits = points(spark, p, label=[0] * 80 + [1] * 80 + [2] * 80, e=[1] * 240).withColumn("label", F.col("label").cast("long"))
    pairs = stages.vertex_merge_pairs(hits, ["ev"])
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    merged = stages.apply_merges(hits, pairs, ["ev"], 6).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in merged} == {(0, 160), (2, 80)}


def test_local_directions_and_nearest(spark):
    from cloudloom.functions.moments import local_directions

    bent = np.concatenate((np.stack((np.arange(20.0), np.zeros(20), np.zeros(20)), 1), np.stack((19 + np.arange(1, 15) * 0.1, np.arange(1.0, 15), np.zeros(14)), 1)))
    hits = points(spark, bent, e=[1] * len(bent))
    tips = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0), (0, 1, *map(float, bent[-1]), 0.0, 1.0, 0.0)], "ev int, end int, tx double, ty double, tz double, ox double, oy double, oz double")
    out = {r.end: (r.ux, r.uy, r.uz) for r in local_directions(hits, tips, ["ev"], 6.0).collect()}
    assert out[0] == pytest.approx((-1, 0, 0), abs=1e-6) and out[1][1] > 0.99
    few = {r.end: (r.ux, r.uy) for r in local_directions(hits, tips, ["ev"], 0.5).collect()}
    assert few[0] == pytest.approx((-1, 0), abs=1e-6)
    a = points(spark, np.array([[0.0, 0, 0], [9, 9, 9]])).withColumnRenamed("hit_id", "i")
    b = points(spark, np.array([[1.0, 0, 0], [-1, 0, 0], [0, 3, 0]])).withColumnRenamed("hit_id", "j")
    assert [(r.i, r.j) for r in spatial.nearest(a, b, 2.0, ["ev"], "i", ["j"]).collect()] == [(0, 0)]


def test_sources(spark, tmp_path):
    path = str(tmp_path)
    rows = [("f1", k, 0, 1.0, 2.0, 3.0, -1.0, 5, None, 7, 0.0, 0.0, None) for k in range(4)]
    spark.createDataFrame(rows, readers.HITS).write.parquet(f"{path}/hits")
    h = readers.read_hits(spark, f"{path}/hits").first()
    assert (h.tpc, h.e, h.label) == (2, 0.0, 7) and readers.read_events(spark, f"{path}/hits", 3).count() == 3
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached(spark, f"{path}/cache", {"a": 1}, make).count() == 3
    assert len(made) == 1
    raw = spark.createDataFrame([("f", 1, 3, '[{"label": 1, "type": "track", "tpcs": [1, 2], "e_ok": 1.5}]', '{"1": {"n_tpc": 2}}')], "file_tag string, event_id int, split_index int, lab_rows string, cluster_conf string")
    out = spark.createDataFrame([("f", 1, 95.0)], "file_tag string, event_id int, eff double")
    c = readers.clusters(readers.convert(raw, out)).first()
    assert c.tpcs == [1, 2] and c.backbone and c.confidence.n_tpc == 2
    readers.write_csv(spark.range(2), f"{path}/csv")
    assert spark.read.option("header", True).csv(f"{path}/csv").count() == 2


def test_events_from_a_stream(spark, tmp_path):
    from cloudloom.streaming.events import cluster_stream

    path = str(tmp_path)
    df = spark.createDataFrame(crossing_tracks(0, 0))
    df.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    cluster_stream(stream, ["event_id"], f"{path}/out", f"{path}/ckpt").awaitTermination(60)
    assert spark.read.parquet(f"{path}/out").count() == df.count()
