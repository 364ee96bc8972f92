"""Vector geometry as Column expressions (triples of x, y, z), all inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
TINY = 1e-12


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda p, q: p + q, [p * q for p, q in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(v, F.lit(hi)), F.lit(lo))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return tuple(F.when(n > TINY, p / n).otherwise(0.0) for p in a)


def fixed_sign(d: Vec) -> Vec:
    """A direction turned so that its largest component is positive (the first of equals)."""
    ax, ay, az = (F.abs(p) for p in d)
    lead = F.when((ax >= ay) & (ax >= az), d[0]).when(ay >= az, d[1]).otherwise(d[2])
    return tuple(F.when(lead < 0, -p).otherwise(p) for p in d)


def line_distance(p: Vec, c: Vec, d: Vec) -> Column:
    """Distance of a point to an infinite line through ``c`` along the unit vector ``d``."""
    r = sub(p, c)
    return F.sqrt(F.greatest(dot(r, r) - dot(r, d) * dot(r, d), F.lit(0.0)))


def point_segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance of a point to a segment; the foot is clamped to its ends."""
    u = sub(b, a)
    n = dot(u, u)
    t = F.when(n > TINY, clip(dot(sub(p, a), u) / n, 0, 1)).otherwise(0.0)
    return distance(p, add(a, scale(u, t)))


def line_line_distance(p1: Vec, v1: Vec, p2: Vec, v2: Vec) -> Column:
    """Closest approach of two infinite lines; of parallels the perpendicular distance."""
    a, b = unit(v1), unit(v2)
    w = sub(p1, p2)
    k = dot(a, b)
    den = 1 - k * k
    d, e = dot(a, w), dot(b, w)
    s, t = (k * e - d) / den, (e - k * d) / den
    apart = distance(add(p1, scale(a, s)), add(p2, scale(b, t)))
    flat = (norm(v1) < TINY) | (norm(v2) < TINY)
    return F.when(flat, norm(w)).when(den < TINY, norm(cross(w, a))).otherwise(apart)


def segment_distance_clamped(p1: Vec, q1: Vec, p2: Vec, q2: Vec) -> Column:
    """Segment distance with both line parameters clamped on their own (an upper bound)."""
    u, v, w = sub(q1, p1), sub(q2, p2), sub(p1, p2)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    den = a * c - b * b
    s, t = clip((b * e - c * d) / den, 0, 1), clip((a * e - b * d) / den, 0, 1)
    apart = distance(add(p1, scale(u, s)), add(p2, scale(v, t)))
    to_v, to_u = norm(v) + TINY, norm(u) + TINY
    near = F.least(norm(cross(w, v)) / to_v, norm(cross(sub(q1, p2), v)) / to_v, norm(cross(w, u)) / to_u, norm(cross(sub(q2, p1), u)) / to_u)
    return F.when(den < TINY, near).otherwise(apart)


def segment_distance(p1: Vec, q1: Vec, p2: Vec, q2: Vec) -> Column:
    """Exact segment distance: one parameter is solved again where the other is clamped."""
    u, v, r = sub(q1, p1), sub(q2, p2), sub(p1, p2)
    a, e, f, c, b = dot(u, u), dot(v, v), dot(v, r), dot(u, r), dot(u, v)
    den = a * e - b * b
    s0 = F.when(den > TINY, clip((b * f - c * e) / den, 0, 1)).otherwise(0.0)
    t0 = F.when(e > TINY, (b * s0 + f) / e).otherwise(0.0)
    t = clip(t0, 0, 1)
    again = lambda top: F.when(a > TINY, clip(top / a, 0, 1)).otherwise(0.0)
    s = F.when(t0 < 0, again(-c)).when(t0 > 1, again(b - c)).otherwise(s0)
    return distance(add(p1, scale(u, s)), add(p2, scale(v, t)))


def angle_degrees(a: Vec, b: Vec) -> Column:
    """Unsigned angle of two directions; 180 if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n < TINY, 180.0).otherwise(F.degrees(F.acos(F.least(F.abs(dot(a, b)) / n, F.lit(1.0)))))


def gap_parts(tip_i: Vec, out_i: Vec, tip_j: Vec, out_j: Vec) -> tuple[Column, Column]:
    """Transverse and longitudinal parts of the gap between two ends along their common axis."""
    axis, gap = unit(sub(out_i, out_j)), sub(tip_j, tip_i)
    along = dot(gap, axis)
    return F.sqrt(F.greatest(dot(gap, gap) - along * along, F.lit(0.0))), F.abs(along)


def extend_to_box(p: Vec, d: Vec, lo: Vec, hi: Vec) -> tuple[Column, Column]:
    """Line parameters (first, last) inside a box by slab clipping; null if the line misses it."""
    first, last, ok = F.lit(float("-inf")), F.lit(float("inf")), F.lit(True)
    for k in range(3):
        a, b = (lo[k] - p[k]) / d[k], (hi[k] - p[k]) / d[k]
        flat = F.abs(d[k]) < TINY
        first = F.when(flat, first).otherwise(F.greatest(first, F.least(a, b)))
        last = F.when(flat, last).otherwise(F.least(last, F.greatest(a, b)))
        ok = ok & (~flat | ((p[k] >= lo[k]) & (p[k] <= hi[k])))
    hit = ok & (first <= last)
    return F.when(hit, first), F.when(hit, last)


def depth_in_box(p: Vec, lo: Vec, hi: Vec) -> Column:
    """Distance to the nearest face, from inside (negative outside)."""
    return F.least(*[x for k in range(3) for x in (p[k] - lo[k], hi[k] - p[k])])


def logistic(features: list[Column], mean: list[float], sd: list[float], coef: list[float], intercept: float) -> Column:
    """Score of a standardised logistic model."""
    z = reduce(lambda a, b: a + b, [(f - m) / s * c for f, m, s, c in zip(features, mean, sd, coef, strict=True)])
    return 1 / (1 + F.exp(-(z + intercept)))


def log10_floor(v: Column, floor: float = 0.1) -> Column:
    return F.log10(F.greatest(v, F.lit(floor)))


def gap_score(perp: Column, nearest: Column, overrun: Column) -> Column:
    """Mixed distance score of a hit to a track: across, to its nearest hit, beyond its end."""
    return 0.70 * perp + 0.20 * nearest + 0.10 * overrun
