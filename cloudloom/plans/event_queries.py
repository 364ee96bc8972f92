"""Registered queries over points of several events: sweeps, segment pairs, corridors, windows.

The points of ``embeddings`` are dealt to three events here; segments are lines fitted to a label's points in a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import quantiles
from cloudloom.functions.moments import ends, line_moments
from cloudloom.operators import annealing, audit, families, graph, intervals, lineage, links, metrics, segments, sweeps, vertices
from cloudloom.plans.queries import EPS, EV, LINK, LN, PT, _infos, _lsql, moments_sql, query, rounded, rsql
from cloudloom.sources.bindings import event_hits, line_hits, point_hits, table

PE = PT.replace("SELECT 0 AS ev", "SELECT CAST(vec_id % 3 AS INTEGER) AS ev")


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    return point_hits(spark, sf).withColumn("ev", (F.col("hit_id") % 3).cast("int"))


# --- sweeps ----------------------------------------------------------------

RADII, SAMPLES = [6.0, 8.0, 10.0, 12.0, 14.0], 4
SWEEP = f"""WITH RECURSIVE {PE}, ep AS (SELECT unnest({RADII}) AS eps),
ed AS (SELECT eps, p.ev, p.hit_id AS i, q.hit_id AS j FROM ep, pt p JOIN pt q ON p.ev = q.ev AND p.hit_id <> q.hit_id WHERE {EPS} <= eps),
no AS (SELECT eps, ev, i FROM ed GROUP BY ALL HAVING count(*) + 1 >= {SAMPLES}), ce AS (SELECT ed.* FROM ed SEMI JOIN no a ON ed.eps = a.eps AND ed.i = a.i SEMI JOIN no b ON ed.eps = b.eps AND ed.j = b.i),
cc(eps, ev, i, r) AS (SELECT eps, ev, i, i FROM no UNION SELECT ce.eps, ce.ev, ce.j, cc.r FROM cc JOIN ce ON ce.eps = cc.eps AND ce.i = cc.i), co AS (SELECT eps, ev, i, min(r) AS least FROM cc GROUP BY ALL),
nu AS (SELECT eps, i, dense_rank() OVER (PARTITION BY eps, ev ORDER BY least) - 1 AS c FROM co), bo AS (SELECT ed.eps, ed.i, min(c) AS c FROM ed JOIN nu ON ed.eps = nu.eps AND ed.j = nu.i GROUP BY ALL),
sw AS (SELECT pt.ev, hit_id, ep.eps, CAST(coalesce(nu.c, bo.c, -1) AS BIGINT) AS cluster, g, e FROM pt CROSS JOIN ep LEFT JOIN nu ON hit_id = nu.i AND ep.eps = nu.eps LEFT JOIN bo ON hit_id = bo.i AND ep.eps = bo.eps)"""


@query("dbscan_sweep", f"{SWEEP} SELECT ev, hit_id, CAST(eps AS DOUBLE) AS eps, cluster FROM sw")
def dbscan_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters at five radii from one spanning forest."""
    return sweeps.dbscan_sweep(event_points(spark, sf), RADII, SAMPLES, ["ev"])


@query("eps_sweep", f"""{SWEEP}, m AS (SELECT eps, ev, cluster, g, sum(e) AS e FROM sw WHERE cluster >= 0 AND g >= 0 GROUP BY ALL), l AS (SELECT eps, ev, cluster, max(e) AS top, sum(e) AS e FROM m GROUP BY ALL), q AS (SELECT eps, ev, g, max(e) AS top FROM m GROUP BY ALL),
a AS (SELECT eps, ev, sum(top) / sum(e) AS purity, sum(e) AS e, sum(e - top) AS foreign_e, count(*) AS n_clusters FROM l GROUP BY ALL), b AS (SELECT eps, ev, sum(top) AS top FROM q GROUP BY ALL), z AS (SELECT eps, ev, coalesce(sum(e) FILTER (cluster < 0), 0) AS e_noise FROM sw GROUP BY ALL)
SELECT CAST(eps AS DOUBLE) AS eps, ev, round(purity, 6) AS purity, round(top / e, 6) AS completeness, round(foreign_e, 6) AS "foreign", n_clusters, round(e_noise, 6) AS e_noise FROM a JOIN b USING (eps, ev) JOIN z USING (eps, ev)""")
def eps_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the clusters at each radius and event, as a tuning scan reads them."""
    points = event_points(spark, sf)
    hits = sweeps.dbscan_sweep(points, RADII, SAMPLES, ["ev"]).join(points.select("ev", "hit_id", "g", "e"), ["ev", "hit_id"]).withColumnRenamed("cluster", "label")
    keys = ["eps", "ev"]
    score = metrics.purity_completeness(hits, keys).select(*keys, "purity", "completeness", "n_clusters")
    foreign = metrics.dominant(hits, keys).groupBy(*keys).agg(F.sum("e_foreign").alias("foreign"))
    return rounded(score.join(foreign, keys).join(metrics.noise(hits, keys).select(*keys, "e_noise"), keys)).withColumns({c: F.round(c, 6) for c in ("foreign", "e_noise")})


# --- segments --------------------------------------------------------------

SEG = f"""{PE}, {moments_sql('pt', 'ev, label, tpc')},
sg AS (SELECT ev, label * 4 + tpc AS id, tpc, n, e, linearity, cx + tmin * dx AS ax, cy + tmin * dy AS ay, cz + tmin * dz AS az, cx + tmax * dx AS bx, cy + tmax * dy AS by_, cz + tmax * dz AS bz, dx, dy, dz, length FROM mo WHERE n >= 3)"""
TIP = "tp AS (SELECT ev, id, 0 AS tip, ax AS tx, ay AS ty, az AS tz, -dx AS ox, -dy AS oy, -dz AS oz FROM sg UNION ALL SELECT ev, id, 1, bx, by_, bz, dx, dy, dz FROM sg)"
NEAR = "ne AS (SELECT p.ev, p.id AS i, q.id AS j, sqrt((p.tx - q.tx) ** 2 + (p.ty - q.ty) ** 2 + (p.tz - q.tz) ** 2) AS gap, p.tip AS ti, q.tip AS tj FROM tp p JOIN tp q ON p.ev = q.ev AND p.id < q.id QUALIFY row_number() OVER (PARTITION BY p.ev, p.id, q.id ORDER BY gap, p.tip, q.tip) = 1)"


def apart_sql(src: str, more: str) -> str:
    """Exact distance of segments (pax .. pbz, qax .. qbz) of a relation: table ``ap`` with dist."""
    return f"""a1 AS (SELECT *, pbx - pax AS ux, pby - pay AS uy, pbz - paz AS uz, qbx - qax AS vx, qby - qay AS vy, qbz - qaz AS vz, pax - qax AS wx, pay - qay AS wy, paz - qaz AS wz FROM {src}),
a2 AS (SELECT *, ux * ux + uy * uy + uz * uz AS uu, ux * vx + uy * vy + uz * vz AS uv, vx * vx + vy * vy + vz * vz AS vv, ux * wx + uy * wy + uz * wz AS uw, vx * wx + vy * wy + vz * wz AS vw FROM a1),
a3 AS (SELECT *, CASE WHEN uu * vv - uv * uv > 1e-12 THEN greatest(least((uv * vw - vv * uw) / (uu * vv - uv * uv), 1), 0) ELSE 0 END AS s0 FROM a2),
a4 AS (SELECT *, (uv * s0 + vw) / vv AS t0 FROM a3), a5 AS (SELECT *, greatest(least(t0, 1), 0) AS t, CASE WHEN t0 < 0 THEN greatest(least(-uw / uu, 1), 0) WHEN t0 > 1 THEN greatest(least((uv - uw) / uu, 1), 0) ELSE s0 END AS s FROM a4),
ap AS (SELECT {more}, sqrt((wx + s * ux - t * vx) ** 2 + (wy + s * uy - t * vy) ** 2 + (wz + s * uz - t * vz) ** 2) AS dist FROM a5)"""


SIDES = ", ".join(f"{s}.{e}{c}{'_' if e + c == 'by' else ''} AS {s}{e}{c}" for s in "pq" for e in "ab" for c in "xyz")


def event_segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Points with the id of their segment, and segments of at least three points."""
    p = event_points(spark, sf).withColumn("id", F.col("label") * 4 + F.col("tpc"))
    return p, graph.stored(ends(line_moments(p, ["ev", "id", "tpc"])).where("n >= 3"))


@query("close_segment_pairs", f"WITH {SEG}, pr AS (SELECT p.ev, p.id AS i, q.id AS j, {SIDES} FROM sg p JOIN sg q ON p.ev = q.ev AND p.id < q.id), {apart_sql('pr', 'ev, i, j')} SELECT ev, i, j, round(dist, 6) AS dist FROM ap WHERE dist <= 2")
def close_segment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of segments within 2 of each other, by the cells that they cross."""
    return rounded(segments.close_segments(event_segments(spark, sf)[1], 2.0, ["ev"]))


@query("stitch_pairs", f"""WITH {SEG}, {TIP}, {NEAR}, bo AS (SELECT ev, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pt GROUP BY ev),
cl AS (SELECT sg.*, greatest(least((lx - ax) / dx, (hx - ax) / dx), least((ly - ay) / dy, (hy - ay) / dy), least((lz - az) / dz, (hz - az) / dz)) AS f, least(greatest((lx - ax) / dx, (hx - ax) / dx), greatest((ly - ay) / dy, (hy - ay) / dy), greatest((lz - az) / dz, (hz - az) / dz)) AS l FROM sg JOIN bo USING (ev)),
dr AS (SELECT ev, id, tpc, linearity, {', '.join(f"CASE WHEN f <= l THEN a{c} + d{c} * {t} ELSE {e}{c}{'_' if e + c == 'by' else ''} END AS {e}{c}{'_' if e + c == 'by' else ''}" for e, t in (('a', 'f'), ('b', 'l')) for c in 'xyz')} FROM cl),
pr AS (SELECT ne.*, least(p.linearity, q.linearity) AS lin, {SIDES} FROM ne JOIN dr p ON ne.ev = p.ev AND i = p.id JOIN dr q ON ne.ev = q.ev AND j = q.id WHERE p.tpc <> q.tpc AND gap <= 60), {apart_sql('pr', 'ev, i, j, gap, ti, tj, lin')},
wa AS (SELECT tp.*, x, y, z, e, abs(z - tz) <= 20 AS near, row_number() OVER (PARTITION BY tp.ev, tp.id, tip ORDER BY sqrt((x - tx) ** 2 + (y - ty) ** 2 + (z - tz) ** 2), x, y, z) AS k FROM tp JOIN pt ON tp.ev = pt.ev AND tp.id = label * 4 + tpc),
wb AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY ev, id, tip) AS n_near FROM wa), wh AS (SELECT * FROM wb WHERE CASE WHEN n_near >= 3 THEN near ELSE k <= 6 END),
lo AS (SELECT l.ev, l.id, l.tip, tx, ty, tz, CASE WHEN dx * ox + dy * oy + dz * oz < 0 THEN -1 ELSE 1 END AS sg, dx, dy, dz FROM (WITH {moments_sql('wh', 'ev, id, tip')} SELECT * FROM lin) l JOIN tp ON l.ev = tp.ev AND l.id = tp.id AND l.tip = tp.tip),
lu AS (SELECT ev, id, tip, tx, ty, tz, sg * dx AS ux, sg * dy AS uy, sg * dz AS uz FROM lo),
ga AS (SELECT ap.*, p.ux * q.ux + p.uy * q.uy + p.uz * q.uz AS dot, q.tx - p.tx AS gx, q.ty - p.ty AS gy, q.tz - p.tz AS gz, p.ux - q.ux AS mx, p.uy - q.uy AS my, p.uz - q.uz AS mz FROM ap JOIN lu p ON ap.ev = p.ev AND i = p.id AND ti = p.tip JOIN lu q ON ap.ev = q.ev AND j = q.id AND tj = q.tip WHERE dist <= 15),
gb AS (SELECT *, sqrt(greatest(gx * gx + gy * gy + gz * gz - (gx * mx + gy * my + gz * mz) ** 2 / (mx * mx + my * my + mz * mz), 0)) AS trans FROM ga WHERE dot <= -0.3),
sc AS (SELECT *, dist / 15 + 0.45 * gap / 60 + 0.35 * (1 + dot) / 0.7 - 0.15 * lin AS score FROM gb WHERE trans <= 40),
sd AS (SELECT ev, i AS s, ti AS tip, score, i, j FROM sc UNION ALL SELECT ev, j, tj, score, i, j FROM sc), fi AS (SELECT ev, i, j FROM sd QUALIFY row_number() OVER (PARTITION BY ev, s, tip ORDER BY round(score, 9), i, j) = 1), ac AS (SELECT ev, i, j FROM fi GROUP BY ALL HAVING count(*) = 2)
SELECT sc.ev, sc.i, sc.j, CAST(ti AS INTEGER) AS end_i, CAST(tj AS INTEGER) AS end_j, round(dist, 4) AS dist, round(gap, 4) AS gap, round(dot, 4) AS dot, round(trans, 4) AS trans, round(score, 4) AS score, ac.i IS NOT NULL AS accepted FROM sc LEFT JOIN ac ON sc.ev = ac.ev AND sc.i = ac.i AND sc.j = ac.j""")
def stitch_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of different cells that continue each other; accepted where best at both ends."""
    hits, seg = event_segments(spark, sf)
    return rounded(segments.stitch_pairs(seg, hits, ["ev"], dist=15.0, ends=60.0, dot=-0.3, window=20.0, trans=40.0), 4)


def end_pairs(spark: SparkSession, sf: str, most: float) -> tuple[DataFrame, DataFrame]:
    """Points, and the nearest ends of segment pairs up to ``most`` apart as rows (ev, pair, ends)."""
    hits, seg = event_segments(spark, sf)
    tip = segments.tips(seg, ["ev"], "id")
    p, q = (tip.select("ev", F.col("id").alias(s), F.col("end").alias(f"end_{s}"), "x", "y", "z") for s in "ij")
    met = segments.eps_join(p, q, most, ["ev"]).where("i < j").groupBy("ev", "i", "j").agg(F.min(F.struct("dist", "end_i", "end_j", "x", "y", "z", "rx", "ry", "rz")).alias("m"))
    return hits, met.select("ev", (F.col("i") * 100 + F.col("j")).alias("pair"), *[F.col(f"m.{s}{c}").alias(f"{e}{c}") for e, s in (("a", ""), ("b", "r")) for c in "xyz"])


@query("corridor_counts", f"""WITH {SEG}, {TIP}, {NEAR}, co AS (SELECT ne.ev, i * 100 + j AS pair, gap, p.tx AS ax, p.ty AS ay, p.tz AS az, q.tx - p.tx AS gx, q.ty - p.ty AS gy, q.tz - p.tz AS gz FROM ne JOIN tp p ON ne.ev = p.ev AND i = p.id AND ti = p.tip JOIN tp q ON ne.ev = q.ev AND j = q.id AND tj = q.tip WHERE gap <= 40),
bo AS (SELECT ev, tpc, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pt WHERE hit_id % 2 = 0 GROUP BY ev, tpc),
sa AS (SELECT ev, pair, 0.05 + 0.9 * k / 18 AS f, ax, ay, az, gx, gy, gz FROM co, (SELECT unnest(range(19)) AS k)), si AS (SELECT sa.ev, pair, f, max(CASE WHEN ax + f * gx BETWEEN lx AND hx AND ay + f * gy BETWEEN ly AND hy AND az + f * gz BETWEEN lz AND hz THEN 1 ELSE 0 END) AS inside FROM sa JOIN bo USING (ev) GROUP BY ALL),
ac AS (SELECT ev, pair, sum(inside) / 19.0 AS active FROM si GROUP BY ALL),
hi AS (SELECT co.ev, pair, gap, ((x - ax) * gx + (y - ay) * gy + (z - az) * gz) / gap AS t, (x - ax) ** 2 + (y - ay) ** 2 + (z - az) ** 2 AS r2 FROM co JOIN pt USING (ev)),
nb AS (SELECT ev, pair, count(*) AS n FROM hi WHERE sqrt(greatest(r2 - t * t, 0)) <= 6 AND t > 1 AND t < gap - 1 GROUP BY ALL)
SELECT ev, pair, round(gap, 6) AS gap, round(active, 6) AS active, coalesce(n, 0) AS n_bridge, round(0.25 * active * gap * 0.5, 6) AS need, gap <= 4 OR active <= 0.35 OR coalesce(n, 0) >= 0.25 * active * gap * 0.5 AS bridged FROM co JOIN ac USING (ev, pair) LEFT JOIN nb USING (ev, pair)""")
def corridor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hits between the ends of segments, and whether they bridge the gap."""
    hits, pairs = end_pairs(spark, sf, 40.0)
    boxes = audit.bounding_boxes(hits.where("hit_id % 2 = 0"), ["ev", "tpc"]).drop("tpc")
    out = segments.bridge_evidence(pairs, hits, boxes, ["ev"], radius=6.0, per_cm=0.5)
    return rounded(out.select("ev", "pair", "gap", "active", "n_bridge", "need", "bridged"))


@query("continuation_votes", f"""WITH {PE}, {moments_sql('pt', 'ev, label, tpc')}, li AS (SELECT * FROM mo WHERE n >= 3),
vo AS (SELECT li.ev, li.label, li.tpc, pt.label AS nxt, hit_id, x, y, z, pt.e, li.dx AS wx, li.dy AS wy, li.dz AS wz, (x - cx) * dx + (y - cy) * dy + (z - cz) * dz AS t, (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 AS r2, tmin, tmax FROM li JOIN pt ON li.ev = pt.ev AND li.label <> pt.label),
vi AS (SELECT * FROM vo WHERE sqrt(greatest(r2 - t * t, 0)) <= 12 AND (t > tmax + 1 AND t <= tmax + 60 OR t < tmin - 1 AND t >= tmin - 60)),
pk AS (SELECT ev, label, tpc, nxt FROM vi GROUP BY ev, label, tpc, nxt HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY ev, label, tpc ORDER BY count(*) DESC, nxt) = 1), ch AS (SELECT vi.* FROM vi JOIN pk USING (ev, label, tpc, nxt)),
fl AS (SELECT * FROM (WITH {moments_sql('ch', 'ev, label, tpc, nxt')} SELECT * FROM lin)), wd AS (SELECT DISTINCT ev, label, tpc, wx, wy, wz FROM ch)
SELECT ev, label, tpc AS part, nxt AS "next", n, round(abs(dx * wx + dy * wy + dz * wz), 4) AS dot FROM fl JOIN wd USING (ev, label, tpc) WHERE abs(dx * wx + dy * wy + dz * wz) >= 0.2""")
def continuation_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The label that continues each segment beyond its span, by the votes of the hits in its tube."""
    hits = event_points(spark, sf)
    lines = graph.stored(line_moments(hits, ["ev", "label", "tpc"]).where("n >= 3").withColumn("part", F.col("tpc")))
    return rounded(segments.continuations(lines, hits, ["ev"], radius=12.0, reach=60.0, least=3, dot=0.2), 4)


# --- windows ---------------------------------------------------------------

WINDOWS = f"""{PE}, tr AS (SELECT * FROM pt WHERE label < 3), {moments_sql('tr', 'ev, label, tpc')}, md AS (SELECT *, greatest(1.2, q90) AS radius FROM mo WHERE n >= 3 AND length >= 5),
cn AS (SELECT md.ev, md.tpc, md.label, pt.label AS other, tmin, tmax, (x - cx) * dx + (y - cy) * dy + (z - cz) * dz AS t, (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 AS r2, radius FROM md JOIN pt ON md.ev = pt.ev AND md.tpc = pt.tpc AND pt.label >= 3),
cw AS (SELECT ev, tpc, label, other, greatest(tmin, min(t) - 3) AS lo, least(tmax, max(t) + 3) AS hi, count(*) AS n, tmax - tmin AS len FROM cn WHERE sqrt(greatest(r2 - t * t, 0)) <= 1.5 * radius AND t >= tmin AND t <= tmax GROUP BY ev, tpc, label, other, tmin, tmax HAVING count(*) >= 2),
xs AS (SELECT p.ev, p.tpc, p.label AS i, q.label AS j, {', '.join(f'{s}.cx + {s}.{t} * {s}.dx AS {s}{e}x, {s}.cy + {s}.{t} * {s}.dy AS {s}{e}y, {s}.cz + {s}.{t} * {s}.dz AS {s}{e}z' for s in 'pq' for e, t in (('a', 'tmin'), ('b', 'tmax')))},
 p.dx * q.dx + p.dy * q.dy + p.dz * q.dz AS k, p.dx * (p.cx - q.cx) + p.dy * (p.cy - q.cy) + p.dz * (p.cz - q.cz) AS d, q.dx * (p.cx - q.cx) + q.dy * (p.cy - q.cy) + q.dz * (p.cz - q.cz) AS e, p.tmin AS pl, p.tmax AS ph, q.tmin AS ql, q.tmax AS qh, p.radius AS pr, q.radius AS qr FROM md p JOIN md q ON p.ev = q.ev AND p.tpc = q.tpc AND p.label < q.label),
{apart_sql('xs', 'ev, tpc, i, j, k, d, e, pl, ph, ql, qh, pr, qr')}, xa AS (SELECT *, acos(least(abs(k), 1)) AS angle, (k * e - d) / (1 - k * k) AS pt_, (e - k * d) / (1 - k * k) AS qt FROM ap WHERE dist <= 1.5 * greatest(pr, qr)),
xb AS (SELECT *, greatest(least((pr + qr) / greatest(sin(angle), 1e-3), 10), 3) AS h FROM xa WHERE angle >= radians(10) AND pt_ - pl > 2 AND ph - pt_ > 2 AND qt - ql > 2 AND qh - qt > 2),
cx_ AS (SELECT ev, tpc, i AS label, j AS other, greatest(pl, pt_ - h) AS lo, least(ph, pt_ + h) AS hi FROM xb UNION ALL SELECT ev, tpc, j, i, greatest(ql, qt - h), least(qh, qt + h) FROM xb)"""


def contact_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Track hits, their models, cloud windows and crossing windows."""
    points = event_points(spark, sf)
    tracks = points.where("label < 3")
    models = graph.stored(intervals.track_cells(tracks, ["ev"], least=3, length=5.0))
    return tracks, models, intervals.cloud_windows(models, points.where("label >= 3"), ["ev"], least=2), intervals.crossing_windows(models, ["ev"], guard=2.0)


@query("contact_windows", f"""WITH {WINDOWS} SELECT ev, tpc, label, other, 'cloud' AS kind, round(lo, 4) AS lo, round(hi, 4) AS hi, n, CASE WHEN hi - lo > 0.5 * len THEN 'long' END AS reason FROM cw
UNION ALL SELECT ev, tpc, label, other, 'crossing', round(lo, 4), round(hi, 4), NULL, NULL FROM cx_""")
def contact_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Where tracks run along clouds and cross each other."""
    _, _, cloud, cross = contact_parts(spark, sf)
    rows = cloud.withColumn("kind", F.lit("cloud")).unionByName(cross.withColumn("kind", F.lit("crossing")), allowMissingColumns=True)
    return rounded(rows.select("ev", "tpc", "label", "other", "kind", "lo", "hi", "n", "reason"), 4)


@query("track_baselines", f"""WITH {WINDOWS}, wi AS (SELECT ev, tpc, label, lo, hi FROM cw UNION ALL SELECT ev, tpc, label, lo, hi FROM cx_),
nb AS (SELECT *, CASE WHEN f > 1 AND length - (f - 1) * 2 < 1 THEN f - 1 ELSE f END AS n_bins FROM (SELECT *, CAST(greatest(ceil(length / 2), 1) AS BIGINT) AS f FROM md)),
hb AS (SELECT nb.ev, nb.tpc, nb.label, least(CAST(floor(((x - cx) * dx + (y - cy) * dy + (z - cz) * dz - tmin) / 2) AS BIGINT), n_bins - 1) AS bin, tr.e FROM tr JOIN nb ON tr.ev = nb.ev AND tr.tpc = nb.tpc AND tr.label = nb.label),
eb AS (SELECT ev, tpc, label, bin, sum(e) AS e FROM hb GROUP BY ALL),
bi AS (SELECT nb.ev, nb.tpc, nb.label, n_bins, b.bin, coalesce(eb.e, 0) / CASE WHEN b.bin = n_bins - 1 THEN length - (n_bins - 1) * 2 ELSE 2 END AS rho FROM nb CROSS JOIN LATERAL (SELECT unnest(range(n_bins)) AS bin) b LEFT JOIN eb ON eb.ev = nb.ev AND eb.tpc = nb.tpc AND eb.label = nb.label AND eb.bin = b.bin),
mk AS (SELECT wi.ev, wi.tpc, wi.label, least(greatest(CAST(floor((lo - tmin) / 2) AS BIGINT), 0), n_bins - 1) - 1 AS lo, least(greatest(CAST(floor((hi - tmin) / 2) AS BIGINT), 0), n_bins - 1) + 1 AS hi FROM wi JOIN nb USING (ev, tpc, label)),
cl AS (SELECT * FROM bi WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.ev = bi.ev AND mk.tpc = bi.tpc AND mk.label = bi.label AND bin BETWEEN lo AND hi)),
me AS (SELECT ev, tpc, label, quantile_cont(rho, 0.5) AS rho0, count(*) AS n_clean FROM cl GROUP BY ALL), sp AS (SELECT ev, tpc, label, 1.4826 * quantile_cont(abs(rho - rho0), 0.5) AS sigma FROM cl JOIN me USING (ev, tpc, label) GROUP BY ALL)
SELECT nb.ev, nb.tpc, nb.label, n_bins, round(rho0, 4) AS rho0, coalesce(n_clean, 0) AS n_clean, round(sigma, 4) AS sigma, coalesce(n_clean >= 5 AND rho0 >= 0.05, false) AS valid FROM nb LEFT JOIN me USING (ev, tpc, label) LEFT JOIN sp USING (ev, tpc, label)""")
def track_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Energy density of tracks outside all contact windows."""
    tracks, models, cloud, cross = contact_parts(spark, sf)
    cols = ["ev", "tpc", "label", "lo", "hi"]
    windows = graph.stored(cloud.select(*cols).unionByName(cross.select(*cols)))
    return rounded(intervals.baselines(tracks, models, windows, ["ev"]), 4)


# --- families --------------------------------------------------------------

FAMILY = f"""pt AS (SELECT 0 AS ev, vec_id AS hit_id, CAST(embedding[1] AS DOUBLE) * 20 * (1 + 4 * (vec_id % 2)) + (vec_id % 7) * 8 AS x, CAST(embedding[2] AS DOUBLE) * 20 + (vec_id % 4) * 6 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z,
 abs(CAST(embedding[4] AS DOUBLE)) * 10 AS e, CAST(label AS BIGINT) AS g, CAST(vec_id % 4 AS INTEGER) AS tpc, (vec_id % 7) * 4 + vec_id % 4 AS label FROM embeddings),
inf AS (SELECT l.*, p.t10, p.t90 FROM (WITH {moments_sql('pt', 'label')} SELECT * FROM lin) l JOIN (SELECT label, quantile_cont(t, 0.1) AS t10, quantile_cont(t, 0.9) AS t90 FROM (SELECT pt.label, (x - cx) * dx + (y - cy) * dy + (z - cz) * dz AS t FROM pt JOIN (WITH {moments_sql('pt', 'label')} SELECT * FROM lin) k USING (label)) GROUP BY label) p USING (label)),
cel AS (SELECT label, arg_max(tpc, (k, -tpc)) AS cell FROM (SELECT label, tpc, count(*) AS k FROM pt GROUP BY ALL) GROUP BY label), tch AS (SELECT DISTINCT label, tpc FROM pt),
mem AS (SELECT label, arg_max(g, (e, -g)) AS family FROM (SELECT label, g, sum(e) AS e FROM pt GROUP BY ALL) GROUP BY label),
nf AS (SELECT inf.*, cell, CASE WHEN inf.label < 8 THEN 1.0 ELSE 0.0 END AS track FROM inf JOIN cel USING (label)),
clo AS (SELECT i.label AS i, family, m.label AS m, m.e AS em, sqrt((i.cx - m.cx) ** 2 + (i.cy - m.cy) ** 2 + (i.cz - m.cz) ** 2) AS dc, abs(i.dx * m.dx + i.dy * m.dy + i.dz * m.dz) AS al FROM nf i JOIN nf m ON i.label <> m.label JOIN mem ON mem.label = m.label WHERE dc <= 45),
few AS (SELECT * FROM clo QUALIFY row_number() OVER (PARTITION BY i, family ORDER BY dc, m) <= 8),
pp AS (SELECT DISTINCT least(i, m) AS a, greatest(i, m) AS b FROM few), pd AS (SELECT a, b, p.hit_id AS ha, q.hit_id AS hb, {EPS} AS d, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz FROM pp JOIN pt p ON p.label = a JOIN pt q ON q.label = b),
pn AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d, ha, hb) = 1), pc AS (SELECT a, b, count(*) FILTER (d <= 3) AS n3 FROM (SELECT a, b, ha, min(d) AS d FROM pd GROUP BY ALL) GROUP BY a, b),
pf AS (SELECT pn.*, n3, d AS f0, ln(1 + n3) AS f1, abs(p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) AS f2, least(p.linearity, q.linearity) AS f3, greatest(p.linearity, q.linearity) AS f4, log10(greatest(least(p.e, q.e), 0.1)) AS f5, log10(greatest(greatest(p.e, q.e), 0.1)) AS f6, log10(least(p.n, q.n)) AS f7, p.track * q.track AS f8,
 sqrt((q.cx - p.cx) ** 2 + (q.cy - p.cy) ** 2 + (q.cz - p.cz) ** 2) AS f9 FROM pn JOIN pc USING (a, b) JOIN nf p ON a = p.label JOIN nf q ON b = q.label), pj AS (SELECT *, 1 / (1 + exp(-({_lsql(links.V0, 10)}))) AS j0 FROM pf),
sid AS (SELECT a AS i, b AS m, d, n3, j0, ax AS ox, ay AS oy, az AS oz, bx AS hx, by_ AS hy, bz AS hz FROM pj UNION ALL SELECT b, a, d, n3, j0, bx, by_, bz, ax, ay, az FROM pj),
me AS (SELECT few.i, family, few.m, d, n3, j0, ox, oy, oz, hx, hy, hz, row_number() OVER (PARTITION BY few.i, family ORDER BY d, few.m) AS kd, row_number() OVER (PARTITION BY few.i, family ORDER BY j0 DESC) AS kj FROM few JOIN sid ON few.i = sid.i AND few.m = sid.m),
be AS (SELECT i, family, sum(n3) AS n3, max(j0) AS j0_max, avg(j0) FILTER (kj <= 2) AS j0_top2 FROM me GROUP BY i, family), ne AS (SELECT * FROM me WHERE kd = 1),
flo AS (SELECT i, family, sum(em * al) / sum(em) AS flow FROM clo WHERE dc <= 30 GROUP BY i, family),
src AS (SELECT c.i, c.family, pt.label AS ml, pt.tpc, x, y, z, e FROM be c JOIN mem ON mem.family = c.family AND mem.label <> c.i JOIN pt ON pt.label = mem.label),
fm AS (SELECT * FROM (WITH {moments_sql('src', 'i, family')} SELECT * FROM lin)), fc AS (SELECT i, family, count(DISTINCT ml) AS size, count(DISTINCT tpc) AS ntpc, list(DISTINCT tpc) AS tpcs FROM src GROUP BY i, family),
al1 AS (SELECT be.*, d, coalesce(flow, 0) AS flow, o.linearity AS lin_i, o.e AS ei, o.cell, (o.cx - fm.cx) * fm.dx + (o.cy - fm.cy) * fm.dy + (o.cz - fm.cz) * fm.dz AS along, (o.cx - fm.cx) ** 2 + (o.cy - fm.cy) ** 2 + (o.cz - fm.cz) ** 2 AS off2, greatest(sqrt(fm.l2 + fm.l3), 0.5) AS spread, greatest(1.645 * sqrt(fm.l1), 0.5) AS half,
 degrees(acos(least(abs(o.dx * w.dx + o.dy * w.dy + o.dz * w.dz), 1))) AS angle, (ox - o.cx) * o.dx + (oy - o.cy) * o.dy + (oz - o.cz) * o.dz BETWEEN o.t10 AND o.t90 AS ii, (hx - w.cx) * w.dx + (hy - w.cy) * w.dy + (hz - w.cz) * w.dz BETWEEN w.t10 AND w.t90 AS im, fm.e AS fe, size, ntpc, tpcs
 FROM be JOIN ne USING (i, family) JOIN fm USING (i, family) JOIN fc USING (i, family) LEFT JOIN flo USING (i, family) JOIN nf o ON o.label = be.i JOIN nf w ON w.label = ne.m),
ff AS (SELECT i AS label, family, d AS d_min, ln(1 + n3) AS n_contact, j0_max, j0_top2, flow, sqrt(greatest(off2 - along * along, 0)) / spread AS r_sigma, least(greatest(abs(along) - half, 0) / (2 * half), 3) AS ext, angle AS ang_nn, CAST(d < 3 AND angle > 25 AND ii AND im AS INTEGER) * 1.0 AS crossing, CAST(d < 3 AND angle < 15 AND NOT ii AND NOT im AS INTEGER) * 1.0 AS endjoin,
 CAST(lin_i > 0.9 AND spread > 4 AND ii AS INTEGER) * 1.0 AS thru_shower, lin_i, log10(greatest(ei, 0.1)) AS e_i, log10(greatest(fe, 0.1)) AS fam_e, log10(size) AS fam_n, spread AS fam_sigma, ntpc * 1.0 AS fam_ntpc, CAST(list_contains(tpcs, cell) AS INTEGER) * 1.0 AS tpc_in FROM al1)"""


def _fsql() -> str:
    m = links.FAMILY
    return " + ".join(f"({c} - ({m['mean'][k]!r})) / {m['scale'][k]!r} * ({m['coef'][k]!r})" for k, c in enumerate(families.FEATURES)) + f" + ({m['intercept']!r})"


def family_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of drawn-out and round clusters side by side, cluster summaries, and families by dominant truth group."""
    v, i = F.col("embedding"), F.col("vec_id")
    x = v[0].cast("double") * 20 * (1 + 4 * (i % 2)) + (i % 7) * 8
    p = table(spark, sf, "embeddings").select(
        F.lit(0).alias("ev"), i.alias("hit_id"), x.alias("x"), (v[1].cast("double") * 20 + (i % 4) * 6).alias("y"), (v[2].cast("double") * 20).alias("z"),
        (F.abs(v[3].cast("double")) * 10).alias("e"), F.col("label").cast("long").alias("g"), (i % 4).cast("int").alias("tpc"), ((i % 7) * 4 + i % 4).alias("label"),
    )
    infos = graph.stored(links.summaries(p, ["ev"], p.where("label < 8").select("ev", "label")))
    return p, infos, graph.stored(metrics.dominant(p, ["ev"]).select("ev", "label", F.col("dom").alias("family")))


@query("family_features", f"WITH {FAMILY} SELECT {rsql('label family ' + ' '.join('*' + c for c in families.FEATURES))} FROM ff")
def family_features(spark: SparkSession, sf: str) -> DataFrame:
    """The eighteen features of every cluster against every family near it."""
    return rounded(families.family_features(*family_input(spark, sf), ["ev"])).drop("ev")


@query("family_score", f"WITH {FAMILY}, sc AS (SELECT label, family, 1 / (1 + exp(-({_fsql()}))) AS s FROM ff), ra AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nx FROM sc WINDOW w AS (PARTITION BY label ORDER BY s DESC, family)) SELECT label, family, round(s, 6) AS s, round(CASE WHEN k = 1 THEN s - nx END, 6) AS margin FROM ra")
def family_score(spark: SparkSession, sf: str) -> DataFrame:
    """The family model's score of the same rows, and each cluster's lead of its best family over the next."""
    features = families.family_features(*family_input(spark, sf), ["ev"])
    return rounded(families.family_scores(features, ["ev"])).drop("ev")


# --- lineage, quantiles, vertices ------------------------------------------

RELABEL = """re AS (SELECT ev, hit_id, label AS old, g, e, CASE WHEN label < 0 AND hit_id % 5 = 0 THEN 500 + ev WHEN label < 0 THEN -1 WHEN label % 9 = 1 THEN label WHEN label % 9 = 2 AND hit_id % 6 = 0 THEN -1 WHEN label % 9 = 3 AND hit_id % 3 = 0 THEN 300 + label WHEN label % 9 IN (4, 5) THEN label - label % 9 + 4
 WHEN label % 9 IN (6, 7) AND hit_id % 2 = 0 THEN 400 + label - label % 9 WHEN label % 9 = 8 THEN -1 ELSE label END AS new FROM ev)"""


def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Event hits with a label before and one after: some labels kept, peeled, split, merged, mixed, lost, some new."""
    q, h, ev = F.col("label"), F.col("hit_id"), F.col("ev")
    new = (
        F.when((q < 0) & (h % 5 == 0), 500 + ev).when(q < 0, -1).when(q % 9 == 1, q).when((q % 9 == 2) & (h % 6 == 0), -1).when((q % 9 == 3) & (h % 3 == 0), 300 + q)
        .when((q % 9).isin(4, 5), q - q % 9 + 4).when((q % 9).isin(6, 7) & (h % 2 == 0), 400 + q - q % 9).when(q % 9 == 8, -1).otherwise(q)
    )
    return event_hits(spark, sf).select("ev", "hit_id", q.alias("old"), new.cast("long").alias("new"), "g", "e")


@query("label_lineage", f"""WITH RECURSIVE {EV}, {RELABEL}, ov AS (SELECT ev, CASE WHEN old >= 0 THEN old END AS o, CASE WHEN new >= 0 THEN new END AS w, count(*) AS n, sum(e) AS e FROM re GROUP BY ALL HAVING o IS NOT NULL OR w IS NOT NULL),
nd AS (SELECT DISTINCT ev, o * 2 AS i FROM ov WHERE o IS NOT NULL UNION SELECT DISTINCT ev, w * 2 + 1 FROM ov WHERE w IS NOT NULL), ed AS (SELECT ev, o * 2 AS i, w * 2 + 1 AS j FROM ov WHERE o IS NOT NULL AND w IS NOT NULL UNION ALL SELECT ev, w * 2 + 1, o * 2 FROM ov WHERE o IS NOT NULL AND w IS NOT NULL),
cc(ev, i, r) AS (SELECT ev, i, i FROM nd UNION SELECT ed.ev, ed.j, cc.r FROM cc JOIN ed ON ed.ev = cc.ev AND ed.i = cc.i), co AS (SELECT ev, i, min(r) AS root FROM cc GROUP BY ev, i),
si AS (SELECT ev, root, count(*) FILTER (i % 2 = 0) AS olds, count(*) FILTER (i % 2 = 1) AS news, coalesce(min(i // 2) FILTER (i % 2 = 0), min(i // 2)) AS component FROM co GROUP BY ev, root),
su AS (SELECT ov.ev, co.root, sum(e) FILTER (o IS NOT NULL AND w IS NOT NULL) AS ek, sum(e) FILTER (w IS NULL) AS el, sum(e) FILTER (o IS NULL) AS eg, sum(n) FILTER (w IS NULL) AS nl, sum(n) FILTER (o IS NULL) AS ng, sum(n) AS n FROM ov JOIN co ON ov.ev = co.ev AND co.i = coalesce(o * 2, w * 2 + 1) GROUP BY ALL)
SELECT ev, component, CASE WHEN news = 0 THEN 'lost' WHEN olds = 0 THEN 'new' WHEN olds > 1 AND news > 1 THEN 'mixed' WHEN news > 1 THEN 'split' WHEN olds > 1 THEN 'merged' WHEN nl > 0 THEN 'peeled' WHEN ng > 0 THEN 'fed' ELSE 'kept' END AS kind, olds, news,
 round(coalesce(ek, 0), 6) AS e_kept, round(coalesce(el, 0), 6) AS e_lost, round(coalesce(eg, 0), 6) AS e_gained, CAST(n AS BIGINT) AS n FROM si JOIN su USING (ev, root)""")
def label_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every label between two labellings."""
    hits = relabelled(spark, sf)
    table = lineage.overlaps(hits.select("ev", "hit_id", F.col("old").alias("label"), "e"), hits.select("ev", "hit_id", F.col("new").alias("label")), ["ev", "hit_id"], ["ev"])
    return lineage.lineage(table, ["ev"]).withColumns({c: F.round(c, 6) for c in ("e_kept", "e_lost", "e_gained")})


@query("separation_audit", f"""WITH {EV}, {RELABEL}, t AS (SELECT ev, old, CASE WHEN new >= 0 THEN new END AS w, CASE WHEN g >= 0 THEN g END AS g, sum(e) AS e FROM re WHERE old >= 0 GROUP BY ALL),
p AS (SELECT ev, old, w, sum(e) AS e_new, arg_max(g, (e, -g)) FILTER (g IS NOT NULL) AS dom FROM t GROUP BY ev, old, w), k AS (SELECT ev, old, w AS keeper, dom AS kd FROM p WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ev, old ORDER BY CASE WHEN w = old THEN 0 ELSE 1 END, e_new DESC, w) = 1)
SELECT p.ev, p.old, p.w AS new, round(e_new, 6) AS e_new, round(coalesce((SELECT sum(t.e) FROM t WHERE t.ev = p.ev AND t.old = p.old AND t.w IS NOT DISTINCT FROM p.w AND t.g <> k.kd), 0), 6) AS e_foreign, CASE WHEN dom IS NULL OR kd IS NULL THEN 'no_truth' WHEN dom = kd THEN 'broke_same' ELSE 'separated' END AS verdict
FROM p JOIN k USING (ev, old) WHERE p.w IS DISTINCT FROM keeper""")
def separation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every part that left its label."""
    return lineage.separation_audit(relabelled(spark, sf), ["ev"]).withColumns({"e_new": F.round("e_new", 6), "e_foreign": F.round("e_foreign", 6)})


@query("exact_quantiles", f"WITH {LN} SELECT tpc, {', '.join(f'round(quantile_cont(e, {s}), 6) AS q{k}' for k, s in enumerate((0.05, 0.5, 0.68, 0.999)))} FROM ln GROUP BY tpc")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of groups that are refined by histograms because they are too large to rank at once."""
    return rounded(quantiles.exact_quantiles(line_hits(spark, sf), ["tpc"], "e", [0.05, 0.5, 0.68, 0.999], large=1000, bins=64, few=50))


@query("track_vertices", f"""WITH RECURSIVE {SEG}, {TIP}, ed AS (SELECT p.ev, p.id * 2 + p.tip AS i, q.id * 2 + q.tip AS j FROM tp p JOIN tp q ON p.ev = q.ev AND (p.id <> q.id OR p.tip <> q.tip) WHERE sqrt((p.tx - q.tx) ** 2 + (p.ty - q.ty) ** 2 + (p.tz - q.tz) ** 2) <= 9),
no AS (SELECT ev, i FROM ed GROUP BY ev, i HAVING count(*) + 1 >= 2), ce AS (SELECT ed.* FROM ed SEMI JOIN no a ON ed.ev = a.ev AND ed.i = a.i SEMI JOIN no b ON ed.ev = b.ev AND ed.j = b.i),
cc(ev, i, r) AS (SELECT ev, i, i FROM no UNION SELECT ce.ev, ce.j, cc.r FROM cc JOIN ce ON ce.ev = cc.ev AND ce.i = cc.i), co AS (SELECT ev, i, min(r) AS least FROM cc GROUP BY ev, i),
nu AS (SELECT ev, i, dense_rank() OVER (PARTITION BY ev ORDER BY least) - 1 AS c FROM co), bo AS (SELECT ed.ev, ed.i, min(c) AS c FROM ed JOIN nu ON ed.ev = nu.ev AND ed.j = nu.i GROUP BY ALL),
al AS (SELECT DISTINCT tp.ev, tp.id, coalesce(nu.c, bo.c) AS c FROM tp LEFT JOIN nu ON tp.ev = nu.ev AND tp.id * 2 + tp.tip = nu.i LEFT JOIN bo ON tp.ev = bo.ev AND tp.id * 2 + tp.tip = bo.i WHERE coalesce(nu.c, bo.c) IS NOT NULL),
ln AS (SELECT mo.ev, label * 4 + tpc AS id, cx, cy, cz, dx, dy, dz FROM mo), pr AS (SELECT p.ev, p.c, s.dx * t.dx + s.dy * t.dy + s.dz * t.dz AS k, s.dx AS ax, s.dy AS ay, s.dz AS az, t.dx AS bx, t.dy AS by_, t.dz AS bz, s.cx - t.cx AS wx, s.cy - t.cy AS wy, s.cz - t.cz AS wz
 FROM al p JOIN al q ON p.ev = q.ev AND p.c = q.c AND p.id < q.id JOIN ln s ON s.ev = p.ev AND s.id = p.id JOIN ln t ON t.ev = q.ev AND t.id = q.id),
ps AS (SELECT *, (k * (bx * wx + by_ * wy + bz * wz) - (ax * wx + ay * wy + az * wz)) / (1 - k * k) AS s, (bx * wx + by_ * wy + bz * wz - k * (ax * wx + ay * wy + az * wz)) / (1 - k * k) AS t FROM pr),
md AS (SELECT ev, c, quantile_cont(sqrt((wx + s * ax - t * bx) ** 2 + (wy + s * ay - t * by_) ** 2 + (wz + s * az - t * bz) ** 2), 0.5) AS dca FROM ps GROUP BY ev, c HAVING dca <= 8),
nt AS (SELECT ev, c, count(*) AS n FROM al GROUP BY ev, c), vx AS (SELECT md.ev, md.c, n, row_number() OVER (PARTITION BY md.ev ORDER BY md.c) - 1 AS v FROM md JOIN nt USING (ev, c)),
mi AS (SELECT al.ev, al.id, min(v) AS v, arg_min(n, v) AS n FROM al JOIN vx USING (ev, c) GROUP BY ALL), cn AS (SELECT ev, count(*) AS k FROM vx GROUP BY ev)
SELECT sg.ev, sg.id, CAST(CASE WHEN mi.v IS NULL THEN coalesce(k, 0) + row_number() OVER (PARTITION BY sg.ev, mi.v IS NULL ORDER BY sg.id) - 1 ELSE mi.v END AS BIGINT) AS vertex, CASE WHEN mi.v IS NULL THEN 'track' WHEN mi.n >= 3 THEN 'shower' ELSE 'vertex' END AS type
FROM sg LEFT JOIN mi ON sg.ev = mi.ev AND sg.id = mi.id LEFT JOIN cn ON sg.ev = cn.ev""")
def track_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of segments by their ends and lines."""
    return vertices.assign_vertices(event_segments(spark, sf)[1], ["ev"], eps=9.0, least=2, dca=8.0)


# --- soft assignment -------------------------------------------------------

BETAS, ROUNDS, DAMPING = (0.5, 1.5), 3, 0.3


def rounds_sql() -> str:
    """Message rounds over s0 (a, b, j0) and fi (node, slot, field), one after another; last are the beliefs."""
    out = ["d0 AS (SELECT a AS src, b AS dst, j0 * 0.05 AS j, slot, -ln(3) AS m FROM s0, (SELECT unnest([0, 1, 2]) AS slot) UNION ALL SELECT b, a, j0 * 0.05, slot, -ln(3) FROM s0, (SELECT unnest([0, 1, 2]) AS slot))"]
    steps = [b for b in BETAS for _ in range(ROUNDS)]
    belief = "b{0} AS (SELECT node, fi.slot, field * {1} + coalesce(h, 0) AS v FROM fi LEFT JOIN (SELECT dst, slot, sum(m) AS h FROM d{0} GROUP BY dst, slot) s ON dst = node AND s.slot = fi.slot)"
    for r, beta in enumerate(steps):
        out.append(belief.format(r, beta))
        out.append(f"c{r} AS (SELECT d.*, v - k.m AS v FROM d{r} d JOIN b{r} ON node = d.src AND b{r}.slot = d.slot JOIN d{r} k ON k.src = d.dst AND k.dst = d.src AND k.slot = d.slot)")
        out.append(f"n{r} AS (SELECT src, dst, j, slot, m, exp(v - max(v) OVER w) AS u FROM c{r} WINDOW w AS (PARTITION BY src, dst))")
        out.append(f"d{r + 1} AS (SELECT src, dst, j, slot, {DAMPING} * m + {1 - DAMPING} * ln((1 + (exp(j * {beta}) - 1) * u / sum(u) OVER (PARTITION BY src, dst)) / (2 + exp(j * {beta}))) AS m FROM n{r})")
    out.append(belief.format(len(steps), steps[-1]))
    out.append(f"ex AS (SELECT node, slot, exp(v - max(v) OVER (PARTITION BY node)) AS u FROM b{len(steps)})")
    return ",\n".join(out)


@query("soft_assignments", f"""{LINK}, fi AS (SELECT label AS node, slot, ln((coalesce(sum(e) FILTER (g % 3 = slot), 0) + 0.05 * sum(e)) / (1.15 * sum(e))) AS field FROM pt, (SELECT unnest([0, 1, 2]) AS slot) GROUP BY label, slot),
{rounds_sql()} SELECT node, CAST(slot AS INTEGER) AS slot, round(u / sum(u) OVER (PARTITION BY node), 6) AS p FROM ex""")
def soft_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters over three slots: their energy's shares as fields, link scores as couplings, two temperatures."""
    p, infos = _infos(spark, sf)
    infos = graph.stored(infos)
    scored = links.score_v0(links.candidate_pairs(infos, p, ["ev"]), infos, ["ev"]).select("ev", "a", "b", F.col("j0").alias("j"))
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.when(F.col("g") % 3 == s, F.col("e")).otherwise(0.0).alias("part")) for s in range(3)]))
    shares = p.select("ev", F.col("label").alias("node"), "e", slots.alias("_s")).groupBy("ev", "node", "_s.slot").agg(F.log((F.sum("_s.part") + 0.05 * F.sum("e")) / (1.15 * F.sum("e"))).alias("field"))
    out = annealing.anneal(shares, graph.stored(scored), ["ev"], betas=BETAS, damping=DAMPING, tolerance=0.0, max_rounds=ROUNDS, strength=0.05)
    return rounded(out.beliefs.drop("ev"))


# --- the chain -------------------------------------------------------------


@query("relational_chain")
def relational_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all points after every stage of the chain, no event in one task."""
    from cloudloom.plans import relations
    from cloudloom.plans.config import ChainConfig

    cfg = ChainConfig.of(rescue_eps=9.0, rescue_hits=5, rescue_length=10.0, rescue_linearity=0.4, rescue_rms=30.0, lam=3.0, leftover_eps=8.0, stitch_dist=15.0, stitch_end=60.0, stitch_dot=-0.3, stitch_window=20.0, stitch_trans=40.0)
    return relations.chain(event_points(spark, sf), ["ev"], config=cfg)


@query("stage_scores")
def stage_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores after each stage of the chain."""
    from cloudloom.plans import relations

    return rounded(relations.stage_scores(relational_chain(spark, sf), event_points(spark, sf), ["ev"]))
