"""Column geometry and moments against numpy, degenerate input included."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import geom
from cloudloom.functions.moments import ends, line_moments
from cloudloom.operators import kernels as K


def _frame(spark, rows, names):
    cols = [f"{n}{c}" for n in names for c in "xyz"]
    return spark.createDataFrame([tuple(float(v) for p in r for v in p) for r in rows], ", ".join(f"{c} double" for c in cols))


def _cases():
    rng = np.random.default_rng(0)
    rows = [rng.normal(0, 5, (4, 3)) for _ in range(60)]
    z = np.zeros(3)
    x, y = np.eye(3)[:2]
    return rows + [np.array(r, float) for r in ([z, x, y, x + y], [z, x, z, x], [z, z, y, y], [z, x, 3 * x, 4 * x], [z, x, x / 2 + y, x / 2 - y])]


def test_segment_distances(spark):
    rows = _cases()
    v = [geom.vec(n) for n in "pqrs"]
    out = _frame(spark, rows, "pqrs").select(geom.segment_distance(*v).alias("d"), geom.segment_distance_clamped(*v).alias("c")).collect()
    for r, o in zip(rows, out, strict=True):
        assert o.d == pytest.approx(K.segment_gap(*r)[0], abs=1e-9)
        t = np.linspace(0, 1, 201)
        near = np.linalg.norm((r[0] + t[:, None] * (r[1] - r[0]))[:, None] - (r[2] + t[:, None] * (r[3] - r[2]))[None], axis=2).min()
        assert o.d <= near + 1e-9 and o.d >= near - 0.3
        if not np.allclose(np.cross(r[1] - r[0], r[3] - r[2]), 0):
            assert o.c >= o.d - 1e-9


def test_lines_points_angles(spark):
    rows = _cases()
    p, q, r, s = (geom.vec(n) for n in "pqrs")
    out = _frame(spark, rows, "pqrs").select(
        geom.line_line_distance(p, q, r, s).alias("dca"), geom.angle_degrees(q, s).alias("angle"), geom.point_segment_distance(p, r, s).alias("seg"), geom.line_distance(p, r, geom.unit(s)).alias("line"), F.struct(*geom.fixed_sign(q)).alias("sign"),
    ).collect()
    for (a, u, b, v), o in zip(rows, out, strict=True):
        n = np.cross(u, v)
        if np.linalg.norm(n) > 1e-6:
            assert o.dca == pytest.approx(abs((a - b) @ n) / np.linalg.norm(n), abs=1e-7)
            assert o.angle == pytest.approx(np.degrees(np.arccos(min(1, abs(u @ v) / np.linalg.norm(u) / np.linalg.norm(v)))), abs=1e-6)
        if not u.any() or not v.any():
            assert o.angle == 180
        t = np.linspace(0, 1, 2001)[:, None]
        assert o.seg == pytest.approx(np.linalg.norm(b + t * (v - b) - a, axis=1).min(), abs=1e-2)
        assert max(map(float, o.sign), key=abs) >= 0


def test_box_depth_gap(spark):
    df = _frame(spark, [((1, 1, 1), (1, 0, 0), (0, 0, 0), (4, 4, 4)), ((1, 9, 1), (1, 0, 0), (0, 0, 0), (4, 4, 4))], "pdlh")
    first, last = geom.extend_to_box(*(geom.vec(n) for n in "pdlh"))
    trans, lon = geom.gap_parts(geom.vec("l"), geom.vec("d"), geom.vec("h"), geom.scale(geom.vec("d"), -1.0))
    out = df.select(first.alias("a"), last.alias("b"), geom.depth_in_box(geom.vec("p"), geom.vec("l"), geom.vec("h")).alias("d"), trans.alias("t"), lon.alias("g")).collect()
    assert (out[0].a, out[0].b, out[0].d) == (-1, 3, 1) and out[1].a is None and out[1].d == -5
    assert out[0].t == pytest.approx(np.sqrt(32)) and out[0].g == pytest.approx(4)


def test_moments_against_svd(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0, 1, (50, 3)) * (9, 2, 1), 1: rng.normal(100, 1, (30, 3)), 2: np.array([[1.0, 2, 3]] * 4), 3: np.outer(np.arange(5.0), (1, 1, 0)), 4: np.outer(np.arange(6.0), (0, 0, 2))}
    rows = [(k, i, *map(float, p), 1.0) for k, g in groups.items() for i, p in enumerate(g)]
    out = {r.k: r for r in ends(line_moments(spark.createDataFrame(rows, "k int, hit_id long, x double, y double, z double, e double"), ["k"])).collect()}
    for k, g in groups.items():
        s = np.linalg.svd(g - g.mean(0), compute_uv=False) ** 2
        assert out[k].linearity == pytest.approx(s[0] / max(s.sum(), 1e-12), abs=1e-6)
        line = K.fit(g)
        if s[0] > 1.5 * s[1]:
            assert abs(line.d @ (out[k].dx, out[k].dy, out[k].dz)) == pytest.approx(1, abs=1e-6)
            assert out[k].length == pytest.approx(line.length, abs=1e-6) and out[k].rms == pytest.approx(line.rms, abs=1e-5)
    assert out[2].length == pytest.approx(0)
