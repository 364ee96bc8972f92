"""Annealed message passing against enumeration on trees, and its course on graphs with cycles."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from cloudloom.operators.annealing import anneal, hardened

FIELD, LINK = "ev int, node long, slot int, field double", "ev int, a long, b long, j double"


def exact(fields, links, beta):
    """Marginals by going through all assignments of one event."""
    nodes = sorted({f[1] for f in fields})
    choice = {n: {f[2]: f[3] for f in fields if f[1] == n} for n in nodes}
    total, out = 0.0, {}
    for pick in itertools.product(*[sorted(choice[n]) for n in nodes]):
        at = dict(zip(nodes, pick, strict=True))
        w = math.exp(beta * (sum(choice[n][at[n]] for n in nodes) + sum(j for _, a, b, j in links if at[a] == at[b])))
        total += w
        for n in nodes:
            out[n, at[n]] = out.get((n, at[n]), 0.0) + w
    return {k: v / total for k, v in out.items()}


def planted(seed, ev):
    rng = random.Random(seed)
    fields = [(ev, n, s, rng.uniform(-2, 0)) for n in range(6) for s in range(3) if not (n == 2 and s == 1)]
    return fields, [(ev, rng.randrange(n), n, rng.uniform(0.2, 2)) for n in range(1, 6)]


def test_exact_on_trees(spark):
    (f0, l0), (f1, l1) = planted(1, 0), planted(2, 1)
    out = anneal(spark.createDataFrame(f0 + f1, FIELD), spark.createDataFrame(l0 + l1, LINK), ["ev"], betas=(1.3,), damping=0.0, tolerance=1e-12, max_rounds=12)
    got = {(r.ev, r.node, r.slot): r.p for r in out.beliefs.collect()}
    for ev, f, ln in ((0, f0, l0), (1, f1, l1)):
        want = exact(f, ln, 1.3)
        assert {k[1:] for k in got if k[0] == ev} == set(want)
        assert all(got[ev, *k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert out.residual <= 1e-12 and len(out.rounds) < 12


def test_cooling_settles_a_cycle(spark):
    links = [(0, a, (a + 1) % 4, 1.0) for a in range(4)] + [(0, 4, 4, 9.0), (0, 5, 77, 1.0), (0, 0, 1, None)]
    fields = [(0, n, s, (0.3 if n == 0 and s == 1 else 0.0)) for n in range(6) for s in (0, 1, 2)] + [(0, 5, 7, None)]
    out = anneal(spark.createDataFrame(fields, FIELD), spark.createDataFrame(links, LINK), ["ev"], betas=(0.3, 1.0, 5.0), max_rounds=8, tolerance=1e-4)
    top = {r.node: (r.slot, r.p) for r in hardened(out.beliefs, ["ev"]).collect()}
    assert all(top[n][0] == 1 and top[n][1] > 0.7 for n in range(4)) and top[5][0] is None and top[4] == (None, pytest.approx(1 / 3))
    assert [b for b, _ in out.rounds] == sorted(b for b, _ in out.rounds) and {b for b, _ in out.rounds} == {0.3, 1.0, 5.0}


def test_without_links_or_rows(spark):
    none = spark.createDataFrame([], LINK)
    out = anneal(spark.createDataFrame([(0, 1, 0, 0.0), (0, 1, 1, math.log(3))], FIELD), none, ["ev"], betas=(1.0,))
    assert {r.slot: r.p for r in out.beliefs.collect()} == {0: pytest.approx(0.25), 1: pytest.approx(0.75)} and out.residual == 0
    assert anneal(spark.createDataFrame([], FIELD), none, ["ev"]).beliefs.collect() == []
