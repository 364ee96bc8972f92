"""Stages of one event on its label array: stitch, leftovers, absorption, vertices, merges, splits."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from cloudloom.operators import kernels as K


class _Track:
    """A track's line in a cell, with its radius, its windows and its energy density outside them."""

    def __init__(self, line: K.Line, radius: float):
        self.line, self.radius, self.core = line, radius, max(0.55, 0.5 * radius)
        self.windows: list[tuple[float, float]] = []
        self.baseline = 0.0

    def set_baseline(self, t: np.ndarray, e: np.ndarray, width: float = 2.0) -> None:
        """Median density of the bins that no window touches (nor its neighbours); 0 if too few."""
        lo = float(self.line.t.min())
        n = max(1, int(np.ceil(self.line.length / width)))
        rho = np.bincount(np.clip(((t - lo) / width).astype(int), 0, n - 1), e, n) / width
        free = np.ones(n, bool)
        for a, b in self.windows:
            free[max(0, int((a - lo) // width) - 1) : max(0, int((b - lo) // width) + 2)] = False
        value = float(np.median(rho[free])) if free.sum() >= 5 else 0.0
        self.baseline = value if value >= 0.05 else 0.0


def _largest_gap(t: np.ndarray) -> float:
    return float(np.diff(np.sort(t)).max()) if len(t) > 1 else 0.0


class Event:
    """Points of one event and their labels; labels under ``split`` are tracks, others blobs."""

    def __init__(self, xyz: np.ndarray, e: np.ndarray, tpc: np.ndarray, cfg, seed: int):
        self.p, self.e, self.tpc, self.cfg, self.seed = xyz, np.maximum(np.nan_to_num(e), 0), tpc, cfg, seed
        self.labels = np.full(len(xyz), -1, np.int64)
        self.split = 0
        self.kinds: dict[int, str] = {}
        self.stages: dict[str, np.ndarray] = {}
        self.counts: dict[str, int] = {}

    def of(self, label: int) -> np.ndarray:
        return np.flatnonzero(self.labels == label)

    def tracks(self) -> list[int]:
        return [int(k) for k in np.unique(self.labels[(self.labels >= 0) & (self.labels < self.split)])]

    def blobs(self, least: int) -> list[int]:
        names, counts = np.unique(self.labels[self.labels >= self.split], return_counts=True)
        return [int(k) for k, n in zip(names, counts, strict=True) if n >= least and k >= 0]

    def merge(self, pairs: list[tuple[int, int]]) -> None:
        """Components of label pairs keep their least label."""
        if not pairs:
            return
        names = np.unique(np.array(pairs).ravel())
        i, j = (np.searchsorted(names, np.array([p[k] for p in pairs])) for k in (0, 1))
        root = names[K.components(len(names), i, j)]
        at = np.searchsorted(names, self.labels).clip(0, len(names) - 1)
        hit = names[at] == self.labels
        self.labels = np.where(hit, root[at], self.labels)

    def mark(self, stage: str) -> None:
        self.stages[stage] = self.labels.copy()

    # --- segments to tracks ------------------------------------------------

    def segments(self) -> list[tuple[np.ndarray, K.Line]]:
        out = []
        for cell in np.unique(self.tpc):
            m = np.flatnonzero(self.tpc == cell)
            for part, _ in K.cell_segments(self.p[m], self.cfg, (self.seed, int(cell) & 0xFFFFFFFF)):
                whole = m[part]
                parts = [whole[k] for k in K.split_segment(self.p[whole], self.cfg)] if self.cfg.split else [whole]
                out += [(k, K.fit(self.p[k])) for k in parts]
        return out

    def stitch(self, segs: list[tuple[np.ndarray, K.Line]]) -> list[tuple]:
        """Accepted edges (i, j, end_i, end_j, score) between segments of different cells."""
        cfg, lo, hi = self.cfg, self.p.min(0), self.p.max(0)
        ends = [line.ends() for _, line in segs]
        boxes = [K.to_box(line, lo, hi) for _, line in segs]
        cells = [self.tpc[m[0]] for m, _ in segs]
        known: dict[tuple[int, int], np.ndarray] = {}

        def out(i: int, end: int) -> np.ndarray:
            if (i, end) not in known:
                known[i, end] = K.outward(self.p[segs[i][0]], ends[i][end], ends[i][end] - ends[i][1 - end], cfg.stitch_window, slab=True)
            return known[i, end]

        # The cheap gates for all pairs at once; the others only for what is left.
        tips, ds = np.array(ends), np.array([line.d for _, line in segs])
        flat = tips.reshape(-1, 3)
        gaps = np.sqrt(np.maximum(((flat[:, None] - flat[None]) ** 2).sum(2), 0)).reshape(len(segs), 2, len(segs), 2).transpose(0, 2, 1, 3)
        angles = np.degrees(np.arccos(np.minimum(1.0, np.abs(ds @ ds.T))))
        ok = np.triu(np.array(cells)[:, None] != np.array(cells)[None], 1)
        if cfg.stitch != "legacy":
            ok &= gaps.min((2, 3)) <= cfg.stitch_end
        if cfg.stitch != "directional":
            ok &= angles <= cfg.stitch_angle
        edges = []
        for i, j in np.argwhere(ok).tolist():
            a, b = divmod(int(gaps[i, j].argmin()), 2)
            gap, angle = float(gaps[i, j, a, b]), float(angles[i, j])
            dist = K.segment_gap(*boxes[i], *boxes[j])[0]
            if dist > cfg.stitch_dist:
                continue
            lin = min(segs[i][1].lin, segs[j][1].lin)
            turn = angle / cfg.stitch_angle
            if cfg.stitch == "directional":
                ui, uj = out(i, a), out(j, b)
                dot = float(ui @ uj)
                if dot > cfg.stitch_dot:
                    continue
                if cfg.stitch_trans is not None:
                    axis = (ui - uj) / max(np.linalg.norm(ui - uj), K.TINY)
                    between = ends[j][b] - ends[i][a]
                    if np.sqrt(max(between @ between - (between @ axis) ** 2, 0)) > cfg.stitch_trans:
                        continue
                turn = (1 + dot) / (1 + cfg.stitch_dot)
            edges.append((i, j, a, b, dist / cfg.stitch_dist + 0.45 * gap / cfg.stitch_end + 0.35 * turn - 0.15 * lin))
        if cfg.stitch == "legacy":
            return edges
        best: dict[tuple[int, int], int] = {}
        for n, (i, j, a, b, s) in enumerate(edges):
            for side in ((i, a), (j, b)):
                if side not in best or s < edges[best[side]][4]:
                    best[side] = n
        return [e for n, e in enumerate(edges) if best[e[0], e[2]] == n and best[e[1], e[3]] == n]

    def build(self) -> None:
        """Tracks, leftover clusters, absorption and vertex kinds: the first labelling."""
        cfg, segs = self.cfg, self.segments()
        if not segs:
            return  # without segments every hit stays noise
        edges = self.stitch(segs)
        root = K.components(len(segs), np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
        track = np.full(len(self.p), -1, np.int64)
        for k, (m, _) in enumerate(segs):
            track[m] = np.searchsorted(np.unique(root), root[k])
        n_tracks = len(np.unique(root))
        self.mark_from("segments", segs)
        rest = np.flatnonzero(track < 0)
        blob = K.dbscan(self.p[rest], cfg.leftover_eps, cfg.leftover_min)
        noise = rest[blob < 0]
        best, owner = np.full(len(noise), np.inf), np.full(len(noise), -1)
        for k in range(n_tracks):
            for cell in np.unique(self.tpc[track == k]):
                m = np.flatnonzero((track == k) & (self.tpc == cell))
                if len(m) < 2:
                    continue
                line = K.fit(self.p[m])
                radius = cfg.absorb_scale * max(cfg.lam, cfg.absorb_base, float(np.quantile(line.perp, 0.9)))
                margin = max(cfg.absorb_margin, radius)
                t, perp = line.project(self.p[noise])
                ok = (self.tpc[noise] == cell) & (perp <= radius) & (t >= line.t.min() - margin) & (t <= line.t.max() + margin) & (perp / radius < best)
                best[ok], owner[ok] = (perp / radius)[ok], k
        track[noise[owner >= 0]] = owner[owner >= 0]
        self.counts["absorbed"] = int((owner >= 0).sum())
        groups = self.vertices(track, n_tracks)
        names = np.unique(groups)
        self.labels = np.where(track >= 0, np.searchsorted(names, groups)[np.maximum(track, 0)], -1)
        self.split = len(names)
        sizes = np.bincount(np.searchsorted(names, groups))
        self.kinds = {k: "track" if n == 1 else "shower" if n >= cfg.shower_tracks else "vertex" for k, n in enumerate(sizes)}
        self.labels[rest[blob >= 0]] = self.split + blob[blob >= 0]

    def mark_from(self, stage: str, segs) -> None:
        out = np.full(len(self.p), -1, np.int64)
        for k, (m, _) in enumerate(segs):
            out[m] = k
        self.stages[stage] = out

    def vertices(self, track: np.ndarray, n: int) -> np.ndarray:
        """Group of each track: its own, or the first endpoint cluster of tracks that pass close by."""
        cfg, group = self.cfg, np.arange(n)
        if 2 * n < cfg.vertex_min:
            return group
        lines = [K.fit(self.p[track == k]) for k in range(n)]
        tips = np.concatenate([ln.ends() for ln in lines])
        found = K.dbscan(tips, cfg.vertex_eps, cfg.vertex_min)
        taken: set[int] = set()
        for c in range(found.max() + 1):
            members = sorted({int(k) // 2 for k in np.flatnonzero(found == c)})
            dcas = []
            for x, a in enumerate(members):
                for b in members[x + 1 :]:
                    w, cross = lines[a].c - lines[b].c, np.cross(lines[a].d, lines[b].d)
                    size = np.linalg.norm(cross)
                    dcas.append(abs(w @ cross) / size if size > 1e-6 else np.linalg.norm(np.cross(w, lines[a].d)))
            if len(members) >= 2 and np.median(dcas) <= cfg.vertex_dca:
                free = [k for k in members if k not in taken]
                group[free] = free[0] if free else 0
                taken |= set(free)
        return group

    # --- merges ------------------------------------------------------------

    def boxes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.p[self.tpc == c].min(0), self.p[self.tpc == c].max(0)) for c in np.unique(self.tpc)]

    def _tips(self, label: int, local: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Anchor (mean of the three most extreme points) and outward direction at both ends."""
        p = self.p[self.of(label)]
        order = np.argsort(K.fit(p).t, kind="stable")
        lo, hi = p[order[:3]].mean(0), p[order[-3:]].mean(0)
        return [(a, K.outward(p, a, a - b, local)) for a, b in ((lo, hi), (hi, lo))]

    def vertex_merge(self) -> None:
        good, lines = [], {}
        for k in self.tracks():
            m = self.of(k)
            if len(m) >= 15:
                lines[k] = K.fit(self.p[m])
                if lines[k].length >= 4 and self.kinds.get(k, "track") == "track":
                    good.append(k)
        pairs = []
        for x, a in enumerate(good):
            for b in good[x + 1 :]:
                best = None
                for ea in (0, 1):
                    for eb in (0, 1):
                        pa, pb = lines[a].ends()[ea], lines[b].ends()[eb]
                        gap, mid = float(np.linalg.norm(pa - pb)), (pa + pb) / 2
                        if gap > 4 or best is not None and gap >= best:
                            continue
                        into = lines[a].d * (1 - 2 * ea), lines[b].d * (1 - 2 * eb)
                        turn = np.degrees(np.arccos(np.clip(into[0] @ into[1], -1, 1)))
                        close = all(lines[k].project(mid[None])[1][0] <= 2.5 for k in (a, b))
                        core = any(self._inner_distance(k, lines[k], mid) <= 3 for k in (a, b))
                        if 15 <= turn <= 165 and close and not core:
                            best = gap
                if best is not None:
                    pairs.append((a, b))
        if pairs:
            names = np.unique(np.array(pairs).ravel())
            root = K.components(len(names), np.searchsorted(names, [p[0] for p in pairs]), np.searchsorted(names, [p[1] for p in pairs]))
            sizes = {r: int((root == r).sum()) for r in np.unique(root)}
            pairs = [p for p in pairs if sizes[root[np.searchsorted(names, p[0])]] <= self.cfg.merge_max_group]
        self.merge(pairs)

    def _inner_distance(self, label: int, line: K.Line, at: np.ndarray) -> float:
        """Distance of a point to the hits in the middle (30 to 70 %) of a track."""
        share = (line.t - line.t.min()) / max(line.length, 1e-9)
        q = self.p[self.of(label)][(share >= 0.3) & (share <= 0.7)]
        return float(np.linalg.norm(q - at, axis=1).min(initial=np.inf))

    def rejoin(self) -> None:
        """Join track ends with remnants and with each other across gaps; each end is used once."""
        cfg, boxes = self.cfg, self.boxes()
        ends, rems = [], []
        for k in self.tracks():
            m = self.of(k)
            if self.kinds.get(k, "track") == "track" and len(m) >= 3 and K.fit(self.p[m]).length >= 10:
                ends += [(k, n, len(m), *tip) for n, tip in enumerate(self._tips(k, cfg.stitch_window))]
        for k in self.blobs(15):
            line = K.fit(self.p[self.of(k)])
            if line.rms <= min(0.20 + 0.1653 * line.length, 3.0):
                rems += [(k, n, len(self.of(k)), *tip) for n, tip in enumerate(self._tips(k, cfg.stitch_window))]

        def score(a, b) -> float | None:
            gap = b[3] - a[3]
            size, dot = float(np.linalg.norm(gap)), float(a[4] @ b[4])
            axis = (a[4] - b[4]) / max(np.linalg.norm(a[4] - b[4]), K.TINY)
            trans = float(np.sqrt(max(gap @ gap - (gap @ axis) ** 2, 0)))
            if dot > cfg.rejoin_dot or trans > cfg.rejoin_trans or not self._bridge(a[3], b[3], size, boxes):
                return None
            return trans / cfg.rejoin_trans + (1 + dot) / (1 + cfg.rejoin_dot) + size / cfg.rejoin_gap

        found = []
        at = np.array([a[3] for a in ends]).reshape(-1, 3)
        out = np.array([a[4] for a in ends]).reshape(-1, 3)
        for others, reach in ((rems, cfg.rejoin_search), (ends, cfg.rejoin_gap)):
            bt, bu = (np.array([b[k] for b in others]).reshape(-1, 3) for k in (3, 4))
            i, j, _ = K.near_pairs(at, bt, reach)
            facing = (out[i] * bu[j]).sum(1) <= cfg.rejoin_dot
            for x, y in sorted(zip(i[facing].tolist(), j[facing].tolist(), strict=True)):
                a, b = ends[x], others[y]
                if b[0] == a[0] or others is ends and y <= x or others is rems and b[2] > cfg.rejoin_ratio * a[2]:
                    continue
                if (s := score(a, b)) is not None:
                    found.append((s, a[:2], b[:2]))
        used: set = set()
        pairs = []
        for _, a, b in sorted(found):
            if a not in used and b not in used:
                used |= {a, b}
                pairs.append((a[0], b[0]))
        self.counts["rejoined"] = len(pairs)
        self.merge(pairs)

    def _bridge(self, a: np.ndarray, b: np.ndarray, size: float, boxes) -> bool:
        cfg = self.cfg
        if size <= cfg.rejoin_min_gap:
            return True
        at = a + np.outer(np.linspace(0.05, 0.95, 19), b - a)
        lo, hi = (np.array([box[k] for box in boxes]) for k in (0, 1))
        active = ((at[:, None] >= lo) & (at[:, None] <= hi)).all(2).any(1).mean()
        if active <= cfg.rejoin_active:
            return True
        r, u = self.p - a, (b - a) / size
        t = r @ u
        inside = ((r * r).sum(1) - t * t <= cfg.rejoin_radius**2) & (t > 1) & (t < size - 1)
        return bool(inside.sum() >= cfg.rejoin_occupancy * active * size * 3.0)

    def pinpoint(self) -> None:
        """Merge labels whose local end lines meet in one point."""
        cfg, boxes = self.cfg, self.boxes()
        back = np.inf if cfg.pin_backwall is None else self.p[:, 2].max() - cfg.pin_backwall
        blobs = self.blobs(cfg.pin_blob_hits)
        if cfg.pin_blobs in ("tracklike", "tracklike_boundary"):
            lines = {k: K.fit(self.p[self.of(k)]) for k in blobs}
            shaped = {k for k in blobs if lines[k].lin >= 0.85 and lines[k].length >= 6}
            loose = set() if cfg.pin_blobs == "tracklike" else set(blobs) - shaped
            blobs = [k for k in blobs if k in shaped or k in loose]
        else:
            loose = set()
        first = self.tracks() + ([] if cfg.pin_blobs == "two_phase" else blobs)
        names = [k for k in first if len(self.of(k)) >= 5]
        tips = [(k, *tip) for k in names for tip in self._tips(k, cfg.pin_local)]
        if not tips:
            return
        found = K.dbscan(np.array([t[1] for t in tips]), cfg.pin_eps, cfg.pin_min)
        best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
        for c in range(found.max() + 1):
            members = [tips[k] for k in np.flatnonzero(found == c)]
            for x, a in enumerate(members):
                for b in members[x + 1 :]:
                    if a[0] == b[0]:
                        continue
                    key = (min(a[0], b[0]), max(a[0], b[0]))
                    doca, v = K.segment_gap(*(q for t in (a, b) for q in (t[1] - cfg.pin_local * t[2], t[1] + cfg.pin_eps * t[2])))
                    if key not in best or doca < best[key][0]:
                        best[key] = (doca, v)

        def margin(v: np.ndarray, loose_blob: bool) -> float:
            depth = max([0.0, *(float(np.minimum(v - lo, hi - v).min()) for lo, hi in boxes)])
            return cfg.pin_inner if depth >= cfg.pin_depth else 0.0 if loose_blob else cfg.pin_boundary

        pairs, vertices = [], []
        for key, (doca, v) in sorted(best.items()):
            if v[2] <= back and doca < margin(v, bool(loose & set(key))):
                pairs.append(key)
                vertices.append((v, key[0]))
        if cfg.pin_blobs == "two_phase":
            for k in blobs:
                near = []
                for a, u in self._tips(k, cfg.pin_local):
                    for v, owner in vertices:
                        if np.linalg.norm(v - a) <= 8:
                            p, q = a - cfg.pin_local * u, a + cfg.pin_eps * u
                            t = np.clip((v - p) @ (q - p) / max((q - p) @ (q - p), K.TINY), 0, 1)
                            d = float(np.linalg.norm(v - p - t * (q - p)))
                            if d < margin(v, False):
                                near.append((d, owner))
                if near:
                    pairs.append((min(near)[1], k))
        self.counts["pinpointed"] = len(pairs)
        self.merge(pairs)

    # --- splits and moves --------------------------------------------------

    def refine(self) -> None:
        """Cut big blobs at a finer radius; the largest part and noise keep the label."""
        fresh = int(self.labels.max()) + 1
        for k in self.blobs(self.cfg.refine_hits):
            m = self.of(k)
            sub = K.dbscan(self.p[m], self.cfg.refine_eps, self.cfg.refine_min)
            counts = np.bincount(sub[sub >= 0])
            if len(counts) < 2:
                continue
            for s in range(len(counts)):
                if s != int(counts.argmax()):
                    self.labels[m[sub == s]] = fresh
                    fresh += 1

    def flags(self) -> dict[int, list[int]]:
        """Cells of each label that look like two tracks in one."""
        out: dict[int, list[int]] = {}
        for k in np.unique(self.labels[self.labels >= 0]):
            m = self.of(k)
            for cell in np.unique(self.tpc[m]) if len(m) >= 40 else []:
                w = m[self.tpc[m] == cell]
                if len(w) >= 40:
                    line = K.fit(self.p[w])
                    if line.length >= 15 and np.median(line.perp) >= 1.2 and self.e[w].sum() / line.length >= 2.0:
                        out.setdefault(int(k), []).append(int(cell))
        return out

    def two_track(self) -> None:
        """Give one of two fused lines to the track that continues it, if exactly one is continued."""
        cfg, n = self.cfg, 0
        for k, cells in sorted(self.flags().items()):
            if k >= self.split or self.kinds.get(k, "track") != "track":
                continue
            for cell in cells:
                m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
                if len(m) < 2 * cfg.two_hits:
                    continue
                rms = K.fit(self.p[m]).rms
                rng = np.random.default_rng((self.seed, k, cell & 0xFFFFFFFF))  # by window, so that order does not matter
                best = K.two_lines(self.p[m], cfg.two_iters, cfg.two_inlier, rng) if rms <= cfg.two_rms1 else None
                if best is None or best[1] > min(cfg.two_ratio * rms, cfg.two_rms2):
                    continue
                parts = [m[~best[0]], m[best[0]]]
                lines = [K.fit(self.p[q]) for q in parts]
                if min(map(len, parts)) < cfg.two_hits or min(ln.length for ln in lines) < cfg.two_length:
                    continue
                more = [self._continued(k, ln) for ln in lines]
                if (more[0] is None) != (more[1] is None):
                    c = 0 if more[0] is not None else 1
                    self.labels[parts[c]] = more[c]
                    n += 1
        self.counts["split"] = n

    def _continued(self, own: int, line: K.Line) -> int | None:
        cfg = self.cfg
        t, perp = line.project(self.p)
        lo, hi = line.t.min(), line.t.max()
        beyond = ((t > hi + 1) & (t <= hi + cfg.two_reach)) | ((t < lo - 1) & (t >= lo - cfg.two_reach))
        m = np.flatnonzero((self.labels >= 0) & (self.labels != own) & (self.labels < self.split) & (perp <= cfg.two_radius) & beyond)
        if len(m) < cfg.two_cont:
            return None
        names, counts = np.unique(self.labels[m], return_counts=True)
        k = int(names[counts.argmax()])
        if counts.max() < cfg.two_cont or abs(K.fit(self.p[m[self.labels[m] == k]]).d @ line.d) < cfg.two_dot:
            return None
        return k

    def fragments(self) -> None:
        """Move small labels to that of the nearest hit of a larger one."""
        cfg = self.cfg
        names, counts = np.unique(self.labels[self.labels >= 0], return_counts=True)
        small = names[counts <= cfg.frag_hits]
        i = np.flatnonzero(np.isin(self.labels, small))
        j = np.flatnonzero((self.labels >= (self.split if cfg.frag_blobs_only else 0)) & ~np.isin(self.labels, small))
        a, b, d = K.near_pairs(self.p[i], self.p[j], cfg.frag_radius)
        order = np.lexsort((j[b], d, self.labels[i[a]]))
        owners = self.labels[i[a]][order]
        first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))) if len(owners) else []
        moves = {int(owners[n]): int(self.labels[j[b[order[n]]]]) for n in first}
        for k, to in moves.items():
            self.labels[self.of(k)] = to
        self.counts["fragments"] = len(moves)

    def peel(self) -> None:
        """Take line-like parts beside the core of flagged tracks out into labels of their own."""
        fresh = int(self.labels.max()) + 1
        for k, cells in sorted(self.flags().items()):
            for cell in cells if k < self.split else []:
                m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
                core = K.robust_core(self.p[m], 1.2, self.cfg.two_iters, np.random.default_rng((self.seed, k, cell & 0xFFFFFFFF)))
                if core.sum() < 15 or K.fit(self.p[m[core]]).length < 8:
                    continue
                line, rest = K.fit(self.p[m[core]]), m[~core]
                sub = K.dbscan(self.p[rest], 4.0, 3)
                for s in range(sub.max() + 1 if len(sub) else 0):
                    q = rest[sub == s]
                    if len(q) < 15:
                        continue
                    own, t = K.fit(self.p[q]), line.project(self.p[q])[0]
                    if own.length >= 8 and own.lin >= 0.85 and np.mean((t >= line.t.min()) & (t <= line.t.max())) >= 0.6:
                        self.labels[q] = fresh
                        fresh += 1

    def shower_noise(self) -> None:
        """Noise inside a shower's ellipsoid joins it, nearest first, up to a share of its size."""
        noise = self.of(-1)
        best, owner = np.full(len(noise), np.inf), np.full(len(noise), -1)
        sizes = {}
        for k in [k for k in self.tracks() if self.kinds.get(k) == "shower"]:
            q = self.p[self.of(k)]
            if len(q) < 12:
                continue
            sizes[k] = len(q)
            values, axes = np.linalg.eigh((q - q.mean(0)).T @ (q - q.mean(0)))
            sigma = np.maximum(np.sqrt(np.maximum(values, 0) / (len(q) - 1)), 2.0) * 1.1
            d = np.sqrt((((self.p[noise] - q.mean(0)) @ axes / sigma) ** 2).sum(1))
            ok = (d <= 2.2) & (d < best)
            best[ok], owner[ok] = d[ok], k
        for k, n in sizes.items():
            m = np.flatnonzero(owner == k)
            self.labels[noise[m[np.argsort(best[m], kind="stable")[: max(1, int(0.3 * n))]]]] = k

    def intersections(self) -> None:
        """Settle whose the hits are where tracks cross each other or run into clouds.

        Tracks of a cell are modelled by their line, radius and energy density along it; where they
        meet are windows, and the density outside all windows is a track's baseline.  At crossings
        hits that fit the other line clearly better change over, then the two energy ratios are
        evened out; a track too dense beside a cloud sheds its outermost hits to it.  A hit moves
        once, moves of a pair have an energy limit, a move that tears a track is undone, and all is
        undone if noise or the set of labels changed.
        """
        before = self.labels.copy()
        self.moved = np.zeros(len(self.p), bool)
        for cell in np.unique(self.tpc):
            models = {}
            for k in self.tracks():
                m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
                if len(m) >= 10 and self.kinds.get(k, "track") == "track" and (line := K.fit(self.p[m])).length >= 8:
                    models[k] = _Track(line, max(1.2, float(np.quantile(line.perp, 0.9))))
            crossings = self._crossings(models)
            clouds = self._contacts(models, int(cell))
            for k, model in models.items():
                m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
                model.set_baseline(model.line.project(self.p[m])[0], self.e[m])
            for a, b, mid, half in crossings:
                self._even_out(models, a, b, mid, half, int(cell))
            for k, cloud, lo, hi in clouds:
                self._shed(models[k], k, cloud, lo, hi, int(cell))
        if not np.array_equal(before < 0, self.labels < 0) or set(np.unique(before)) != set(np.unique(self.labels)):
            self.labels = before
        self.counts["intersections"] = int((before != self.labels).sum())

    def _crossings(self, models: dict) -> list[tuple[int, int, np.ndarray, float]]:
        """(a, b, middle, half length) of tracks that cross away from their ends.

        Of the crossings of a cell the first 256 by label are taken, as published; what is left out
        is counted.
        """
        out = []
        names = sorted(models)
        for a, b in combinations(names, 2):
            la, lb = models[a].line, models[b].line
            turn = float(np.degrees(np.arccos(min(1.0, abs(la.d @ lb.d)))))
            gap, mid = K.segment_gap(*la.ends(), *lb.ends())
            if turn < 10 or gap > 1.5 * max(models[a].radius, models[b].radius):
                continue
            at = [float(ln.project(mid[None])[0][0]) for ln in (la, lb)]
            if any(min(t - ln.t.min(), ln.t.max() - t) < 6 for t, ln in zip(at, (la, lb), strict=True)):
                continue
            if len(out) == 256:
                self.counts["crossings left out"] = self.counts.get("crossings left out", 0) + 1
                continue
            half = float(np.clip((models[a].radius + models[b].radius) / np.sin(np.radians(turn)), 3, 10))
            out.append((a, b, mid, half))
            for k, t in zip((a, b), at, strict=True):
                models[k].windows.append((t - half, t + half))
        return out

    def _contacts(self, models: dict, cell: int) -> list[tuple[int, int, float, float]]:
        """(track, cloud, first, last) of stretches where a cloud touches a track, away from its ends."""
        out = []
        for k, model in sorted(models.items()):
            for cloud in self.blobs(1):
                m = np.flatnonzero((self.labels == cloud) & (self.tpc == cell))
                t, perp = model.line.project(self.p[m])
                near = t[(perp <= 1.5 * model.radius) & (t >= model.line.t.min()) & (t <= model.line.t.max())]
                if len(near) < 3:
                    continue
                lo, hi = near.min() - 3, near.max() + 3
                if hi - lo > model.line.length / 2:
                    continue
                model.windows.append((lo, hi))
                if lo >= model.line.t.min() + 6 and hi <= model.line.t.max() - 6:
                    out.append((k, cloud, float(lo), float(hi)))
        return out

    def _try(self, hits: np.ndarray, own: int, to: int, model: _Track, cell: int) -> bool:
        """Move hits, unless that leaves a gap in their track larger than it had (or than 4)."""
        gap = lambda: _largest_gap(model.line.project(self.p[(self.labels == own) & (self.tpc == cell)])[0])
        had = gap()
        self.labels[hits] = to
        if gap() > max(had, 4.0):
            self.labels[hits] = own
            return False
        self.moved[hits] = True
        return True

    def _ratio(self, k: int, model: _Track, mid: np.ndarray, half: float, cell: int) -> tuple[np.ndarray, float]:
        """Hits of a track around a crossing, and their energy over what the baseline expects."""
        m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
        t, centre = model.line.project(self.p[m])[0], float(model.line.project(mid[None])[0][0])
        m = m[np.abs(t - centre) <= half]
        return m, float(self.e[m].sum()) / max(model.baseline * 2 * half, K.TINY)

    def _even_out(self, models: dict, a: int, b: int, mid: np.ndarray, half: float, cell: int) -> None:
        spent = 0.0
        cross = lambda k, m: 0.7 * models[k].line.project(self.p[m])[1]
        for own, other in ((a, b), (b, a)):
            m, _ = self._ratio(own, models[own], mid, half, cell)
            m = m[~self.moved[m] & (np.linalg.norm(self.p[m] - mid, axis=1) <= half)]
            m = m[cross(other, m) + 0.35 < cross(own, m)]
            m = m[np.cumsum(self.e[m]) <= 80.0 - spent]
            if len(m) and self._try(m, own, other, models[own], cell):
                spent += float(self.e[m].sum())
        if min(models[a].baseline, models[b].baseline) <= 0:
            return
        for _ in range(200):
            (ma, ra), (mb, rb) = self._ratio(a, models[a], mid, half, cell), self._ratio(b, models[b], mid, half, cell)
            if abs(ra - rb) <= 0.15:
                return
            own, other, m, ratio = (a, b, ma, ra) if ra > rb else (b, a, mb, rb)
            m = m[~self.moved[m] & (cross(other, m) <= 0.7 * models[other].radius)]
            if not len(m):
                return
            hit = m[np.lexsort((m, cross(other, m) - cross(own, m)))[0]]
            left = ratio - self.e[hit] / (models[own].baseline * 2 * half)
            if left < 1.0 or spent + self.e[hit] > 80.0 or not self._try(np.array([hit]), own, other, models[own], cell):
                return
            spent += float(self.e[hit])

    def _shed(self, model: _Track, k: int, cloud: int, lo: float, hi: float, cell: int) -> None:
        m = np.flatnonzero((self.labels == k) & (self.tpc == cell))
        t, perp = model.line.project(self.p[m])
        inside = (t >= lo) & (t <= hi)
        m, perp = m[inside], perp[inside]
        expected, there = model.baseline * (hi - lo), float(self.e[m].sum())
        target = self.p[(self.labels == cloud) & (self.tpc == cell)]
        if model.baseline <= 0 or there <= 1.5 * expected or there - expected < 3 or not len(target):
            return
        budget = min(80.0, 1.5 * float(self.e[self.labels == cloud].sum()), there - expected)
        for n in np.lexsort((m, -perp)):
            hit = m[n]
            if self.moved[hit] or perp[n] <= model.core or self.e[hit] > budget or np.linalg.norm(target - self.p[hit], axis=1).min() > 2.8:
                continue
            if self._try(np.array([hit]), k, cloud, model, cell):
                budget -= float(self.e[hit])

    def run(self) -> None:
        """The chain of stages that the parameters switch on; labels of each stage are kept."""
        if not len(self.p):
            return
        self.build()
        self.mark("build")
        for name, on in (("intersections", "intersect"), ("vertex_merge", "merge"), ("shower_noise", "showers"), ("rejoin", "rejoin"), ("pinpoint", "pinpoint"), ("refine", "refine"), ("peel", "peel"), ("two_track", "two_track"), ("fragments", "fragments")):
            if getattr(self.cfg, on) and self.split:
                getattr(self, name)()
                self.mark(name)
