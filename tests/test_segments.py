"""Segment index, capsules, stitching and intervals against brute force in plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import intervals, segments

SEG = "ev int, id long, ax double, ay double, az double, bx double, by double, bz double"
NAN = float("nan")


def sticks(n, seed, size=22.0, most=40.0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = [rng.uniform(-size, size) for _ in range(3)]
        d = np.array([rng.gauss(0, 1) for _ in range(3)])
        b = a + d / np.linalg.norm(d) * rng.uniform(0, most)
        out.append((k % 2, k, *a, *b.tolist()))
    return out


def seg_dist(p, q):
    """Distance of two segments by golden sampling: exact enough from the four clamped solutions."""
    a, b, c, d = (np.array(v) for v in (p[:3], p[3:], q[:3], q[3:]))

    def point(x, s, t):
        u = t - s
        n = u @ u
        k = 0 if n < 1e-12 else min(1, max(0, (x - s) @ u / n))
        return np.linalg.norm(x - s - k * u)

    best = min(point(a, c, d), point(b, c, d), point(c, a, b), point(d, a, b))
    u, v, w = b - a, d - c, a - c
    den = (u @ u) * (v @ v) - (u @ v) ** 2
    if den > 1e-12:
        s = ((u @ v) * (v @ w) - (v @ v) * (u @ w)) / den
        t = ((u @ u) * (v @ w) - (u @ v) * (u @ w)) / den
        if 0 <= s <= 1 and 0 <= t <= 1:
            best = min(best, np.linalg.norm(w + s * u - t * v))
    return best


@pytest.mark.parametrize("reach", [3.0, 11.0])
def test_close_segments_equal_all_pairs(spark, reach):
    rows = sticks(90, 1) + [(0, 1000, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (0, 1001, NAN, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 1002, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = {(r.ev, r.i, r.j): r.dist for r in segments.close_segments(spark.createDataFrame(rows, SEG), reach, ["ev"]).collect()}
    want = {}
    for p, q in itertools.combinations(rows[:91], 2):
        if p[0] == q[0] and (d := seg_dist(p[2:], q[2:])) <= reach:
            want[(p[0], p[1], q[1])] = d
    assert set(got) == set(want) and len(want) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert segments.close_segments(spark.createDataFrame([], SEG), reach, ["ev"]).collect() == []


@pytest.mark.parametrize("crowd", [None, 7])
def test_capsules_equal_all_pairs(spark, crowd):
    rng = random.Random(2)
    caps = [(*r, rng.choice([0.7, 2.5, 9.0])) for r in sticks(40, 3)]
    pts = [(k % 2, k, *[rng.uniform(-25, 25) for _ in range(3)]) for k in range(600)] + [(0, 600 + k, 5.0, 5.0, 5.0) for k in range(50)] + [(0, 700, NAN, 0.0, 0.0)]
    df = spark.createDataFrame(caps, SEG + ", radius double"), spark.createDataFrame(pts, "ev int, hit_id long, x double, y double, z double")
    got = sorted((r.ev, r.id, r.hit_id) for r in segments.in_capsules(*df, ["ev"], crowd).collect())
    want = sorted((c[0], c[1], p[1]) for c in caps for p in pts[:-1] if c[0] == p[0] and seg_dist(c[2:8], (*p[2:], *p[2:])) <= c[8])
    assert got == want and len(want) > 50


def line_hits(ev, label, tpc, a, b, n, rng, start):
    a, b = np.array(a), np.array(b)
    return [(ev, label, tpc, start + k, *(a + (b - a) * k / (n - 1) + np.array([rng.gauss(0, 0.05) for _ in range(3)])).tolist(), 1.0) for k in range(n)]


HIT = "ev int, label long, tpc int, hit_id long, x double, y double, z double, e double"


def test_stitching_finds_what_continues(spark):
    from cloudloom.functions.moments import ends, line_moments

    rng = random.Random(4)
    rows = line_hits(0, 1, 0, (0, 0, 0), (40, 2, 4), 60, rng, 0) + line_hits(0, 2, 1, (46, 2.3, 4.6), (90, 4.5, 9), 60, rng, 100)  # one continues the other
    rows += line_hits(0, 3, 1, (46, 2.3, 4.6), (60, 40, 9), 60, rng, 200)  # starts there and turns away
    rows += line_hits(0, 4, 0, (48, 8, 4), (5, 6, 0), 60, rng, 300) + line_hits(1, 5, 1, (46, 2.3, 4.6), (90, 4.5, 9), 60, rng, 400)  # beside it; another event
    hits = spark.createDataFrame(rows, HIT).withColumn("id", F.col("label"))
    seg = ends(line_moments(hits, ["ev", "id", "tpc"]))
    got = segments.stitch_pairs(seg, hits, ["ev"]).collect()
    assert [(r.ev, r.i, r.j, r.accepted) for r in got] == [(0, 1, 2, True)] and got[0].dot < -0.99 and 5 < got[0].gap < 8
    loose = segments.stitch_pairs(seg, hits, ["ev"], dist=30.0, dot=1.0, trans=None).collect()
    assert {(r.i, r.j) for r in loose if r.ev == 0} == {(1, 2), (1, 3), (2, 4), (3, 4)} and sum(r.accepted for r in loose) >= 1
    assert segments.stitch_pairs(seg.limit(0), hits, ["ev"]).collect() == []


def test_bridges(spark):
    rng = random.Random(5)
    ends = [(0, 1, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0), (0, 2, 0.0, 20.0, 0.0, 20.0, 20.0, 0.0), (0, 3, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0), (0, 4, 0.0, 90.0, 0.0, 20.0, 90.0, 0.0)]
    hits = [(0, k, 1 + 18.0 * k / 39, rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in range(40)]
    pairs = spark.createDataFrame(ends, SEG.replace("id", "pair"))
    boxes = spark.createDataFrame([(0, -5.0, -5.0, -5.0, 12.0, 30.0, 5.0), (0, 12.0, -5.0, -5.0, 30.0, 30.0, 5.0)], "ev int, lox double, loy double, loz double, hix double, hiy double, hiz double")
    got = {r.pair: r for r in segments.bridge_evidence(pairs, spark.createDataFrame(hits, "ev int, hit_id long, x double, y double, z double"), boxes, ["ev"]).collect()}
    want = sum(1 < h[2] < 19 and math.hypot(h[3], h[4]) <= 2.5 for h in hits)
    assert (got[1].n_bridge, got[1].active, got[1].bridged) == (want, 1.0, True) and got[1].need == pytest.approx(15)
    assert (got[2].n_bridge, got[2].bridged) == (0, False) and got[3].bridged and (got[4].active, got[4].bridged) == (0.0, True)


def test_continuations(spark):
    rng = random.Random(6)
    rows = line_hits(0, 7, 0, (22, 0, 0), (40, 0, 0), 30, rng, 0) + line_hits(0, 8, 0, (25, 1, 0), (26, -1, 0), 12, rng, 100) + line_hits(0, 9, 0, (-60, 0, 0), (-30, 0, 0), 30, rng, 200)
    lines = spark.createDataFrame([(0, 1, 0, 10.0, 0.0, 0.0, 1.0, 0.0, 0.0, -10.0, 10.0), (0, 2, 0, 10.0, 50.0, 0.0, 1.0, 0.0, 0.0, -10.0, 10.0)], "ev int, label long, part int, cx double, cy double, cz double, dx double, dy double, dz double, tmin double, tmax double")
    got = segments.continuations(lines, spark.createDataFrame(rows, HIT), ["ev"]).collect()
    want = sum(21 < r[4] <= 60 and math.hypot(r[5], r[6]) <= 1.5 for r in rows[:30])
    assert [(r.label, r.part, r.next, r.n) for r in got] == [(1, 0, 7, want)] and got[0].dot > 0.99


def test_intervals(spark):
    rng = random.Random(7)
    made = [(k % 3, float(a := rng.randrange(100)), float(a + rng.randrange(9))) for k in range(40)] + [(0, 5.0, 4.0), (1, None, 3.0), (5, 1.0, 2.0), (5, 2.0, 3.0)]
    df = spark.createDataFrame(made, "ev int, lo double, hi double")
    got = intervals.coalesced(df, ["ev"]).collect()
    for ev in {m[0] for m in made}:
        own = [m for m in made if m[0] == ev and m[1] is not None and m[1] <= m[2]]
        cover = {t / 2 for m in own for t in range(int(2 * m[1]), int(2 * m[2]) + 1)}
        runs = sorted((r.lo, r.hi, r.n) for r in got if r.ev == ev)
        assert {t / 2 for lo, hi, _ in runs for t in range(int(2 * lo), int(2 * hi) + 1)} == cover and sum(n for *_, n in runs) == len(own)
        assert all(a[1] < b[0] for a, b in itertools.pairwise(runs))
    rows = spark.createDataFrame([(ev, float(t)) for ev in range(6) for t in range(110)] + [(0, None)], "ev int, t double")
    free = {(r.ev, r.t) for r in intervals.outside(rows, df, ["ev"], "t").collect()}
    want = {(ev, float(t)) for ev in range(6) for t in range(110) if not any(m[0] == ev and m[1] is not None and m[1] <= t <= m[2] for m in made)}
    assert free == want | {(0, None)}
    assert intervals.coalesced(df.limit(0), ["ev"]).collect() == []


def test_contact_windows_and_baselines(spark):
    rng = random.Random(8)
    rows = line_hits(0, 1, 0, (0, 0, 0), (60, 0, 0), 121, rng, 0) + line_hits(0, 2, 0, (30, -30, 0), (30, 30, 0.3), 121, rng, 200)
    blob = [(0, 50, 0, 900 + k, 10 + rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1), 1.0) for k in range(20)]
    tracks, clouds = spark.createDataFrame(rows, HIT), spark.createDataFrame(blob, HIT)
    models = intervals.track_cells(tracks, ["ev"])
    met = intervals.cloud_windows(models, clouds, ["ev"]).collect()
    assert [(r.label, r.other, r.reason) for r in met] == [(1, 50, None)] and met[0].hi - met[0].lo == pytest.approx(8, abs=0.6)
    cross = {r.label: r for r in intervals.crossing_windows(models, ["ev"]).collect()}
    assert set(cross) == {1, 2} and cross[1].hi - cross[1].lo == pytest.approx(6, abs=1e-6) and abs(cross[2].lo + cross[2].hi) < 1
    both = intervals.cloud_windows(models, clouds, ["ev"]).select("ev", "tpc", "label", "lo", "hi").unionByName(intervals.crossing_windows(models, ["ev"]).select("ev", "tpc", "label", "lo", "hi"))
    base = {r.label: r for r in intervals.baselines(tracks, models, both, ["ev"]).collect()}
    assert base[1].n_bins == base[2].n_bins == 30 and base[1].n_clean < base[2].n_clean < 30 and base[1].rho0 == pytest.approx(2, abs=0.3) and base[1].valid
    free = intervals.baselines(tracks, models, both.limit(0), ["ev"]).collect()
    assert all(r.n_clean == r.n_bins for r in free)
    assert intervals.crossing_windows(models.limit(0), ["ev"]).collect() == []
