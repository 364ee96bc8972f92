"""Small deterministic events with planted lines and blobs, for tests and examples."""

from __future__ import annotations

import numpy as np
import pandas as pd


def line(a, b, n: int, jitter: float, rng: np.random.Generator) -> np.ndarray:
    t = np.sort(rng.random(n))[:, None]
    return np.array(a) + t * (np.array(b) - np.array(a)) + rng.normal(0, jitter, (n, 3))


def event(parts: list[tuple[np.ndarray, int]], width: float = 50.0, event_id: int = 0, energy: float = 1.0) -> pd.DataFrame:
    """Hits of ``parts`` (points, truth group); cells are slabs of ``width`` along x; truth ticks lie 100 apart."""
    p = np.concatenate([q for q, _ in parts])
    g = np.concatenate([np.full(len(q), k) for q, k in parts])
    return pd.DataFrame({"event_id": event_id, "hit_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "e": energy, "tpc": np.floor(p[:, 0] / width).astype(int), "truth_t0": g * 100.0})


def crossing_tracks(seed: int = 0, event_id: int = 0) -> pd.DataFrame:
    """One long track over three cells, one short track, and a blob."""
    rng = np.random.default_rng(seed)
    return event(
        [(line((2, 10, 10), (148, 40, 30), 600, 0.3, rng), 0), (line((5, 80, 50), (45, 60, 90), 200, 0.3, rng), 1), (rng.normal((120, 90, 90), 2.0, (80, 3)), 2)],
        event_id=event_id,
    )
