"""Parameters of the clustering chain: one typed object, two profiles; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ChainConfig:
    # line finder
    lam: float = 1.2
    rss_limit: float = 1.5e6
    iters: int = 800
    min_inliers: int = 35
    k_scale: int = 8
    attach: float = 1.15
    seed: int = 0
    min_length: float = 30.0
    gap_cut: float = 4.0
    gap_min_hits: int = 25
    # segments
    radius: float = 4.0
    seg_min_hits: int = 20
    rescue_eps: float = 4.0
    rescue_min: int = 3
    rescue_hits: int = 15
    rescue_length: float = 20.0
    rescue_linearity: float = 0.88
    rescue_rms: float = 5.0
    # splitter
    split: bool = True
    split_min_hits: int = 60
    split_side_hits: int = 20
    split_share: float = 0.12
    split_span: float = 0.4
    split_sep: float = 2.5
    split_scale: float = 1.5
    split_lin: float = 0.92
    split_dot: float = 0.985
    split_own: float = 1.5
    split_gap: float = 8.0
    # stitch: directional, production or legacy
    stitch: str = "directional"
    stitch_dist: float = 5.0
    stitch_angle: float = 12.0
    stitch_end: float = 40.0
    stitch_dot: float = -0.97
    stitch_window: float = 8.0
    stitch_trans: float | None = 5.0
    # absorption and leftovers
    absorb_scale: float = 1.5
    absorb_base: float = 1.2
    absorb_margin: float = 4.0
    leftover_eps: float = 4.0
    leftover_min: int = 3
    # endpoint vertexing
    vertex_eps: float = 10.0
    vertex_min: int = 9999
    vertex_dca: float = 4.0
    shower_tracks: int = 3
    # vertex merge
    merge: bool = False
    merge_max_group: int = 6
    # rejoin
    rejoin: bool = True
    rejoin_gap: float = 80.0
    rejoin_search: float = 40.0
    rejoin_dot: float = -0.97
    rejoin_trans: float = 5.0
    rejoin_active: float = 0.35
    rejoin_radius: float = 2.5
    rejoin_occupancy: float = 0.5
    rejoin_ratio: float = 0.8
    rejoin_min_gap: float = 4.0
    # pinpoint
    pinpoint: bool = True
    pin_eps: float = 5.0
    pin_min: int = 2
    pin_local: float = 10.0
    pin_inner: float = 1.5
    pin_boundary: float = 0.75
    pin_depth: float = 3.0
    pin_backwall: float | None = 10.0
    pin_blobs: str = "all"  # all, tracklike, tracklike_boundary or two_phase
    pin_blob_hits: int = 15
    # refine, two-track split, fragments, peel, showers, intersections
    refine: bool = True
    refine_hits: int = 500
    refine_eps: float = 2.5
    refine_min: int = 3
    two_track: bool = True
    two_iters: int = 60
    two_inlier: float = 1.2
    two_hits: int = 15
    two_length: float = 8.0
    two_ratio: float = 0.6
    two_rms1: float = 3.0
    two_rms2: float = 0.8
    two_radius: float = 1.5
    two_reach: float = 40.0
    two_cont: int = 10
    two_dot: float = 0.95
    fragments: bool = True
    frag_hits: int = 10
    frag_radius: float = 3.0
    frag_blobs_only: bool = False
    peel: bool = False
    showers: bool = False
    intersect: bool = False

    @staticmethod
    def of(profile: str = "adopted", **changes) -> ChainConfig:
        """A profile with changes; a key that is no parameter raises."""
        known = {f.name for f in fields(ChainConfig)}
        unknown = set(changes) - known
        if unknown:
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        base = {"adopted": {}, "production": {"stitch": "production", "split": False, "vertex_min": 3, "rejoin": False, "pinpoint": False, "refine": False, "two_track": False, "fragments": False}}[profile]
        return replace(ChainConfig(), **{**base, **changes})
