"""Mean shift with a flat kernel."""

from __future__ import annotations

import numpy as np


def estimated_bandwidth(points: np.ndarray, share: float = 0.3) -> float:
    """Mean, over the points, of the distance to the farthest of their nearest share of points."""
    k = max(1, int(len(points) * share))
    total = 0.0
    for p in points:
        total += np.partition(np.hypot(*(points - p).T), k - 1)[k - 1]
    return total / len(points)


def mean_shift(points: np.ndarray, bandwidth: float | None = None, turns: int = 300) -> np.ndarray:
    """A label per point, from 0 for the densest mode; each point moves to the mean of what lies
    within the bandwidth until it rests, and modes closer than that are one."""
    if not len(points):
        return np.empty(0, np.int64)
    bandwidth = bandwidth or estimated_bandwidth(points) or 1.0
    modes: dict[tuple[float, float], int] = {}
    for start in np.unique(points, axis=0):
        at = start
        for _ in range(turns):
            inside = points[np.hypot(*(points - at).T) <= bandwidth]
            moved = inside.mean(axis=0)
            if np.hypot(*(moved - at)) < 1e-3 * bandwidth:
                break
            at = moved
        modes[tuple(at)] = len(inside)
    kept: list[tuple[float, float]] = []
    for mode, _ in sorted(modes.items(), key=lambda m: (-m[1], m[0])):
        if all(np.hypot(mode[0] - k[0], mode[1] - k[1]) > bandwidth for k in kept):
            kept.append(mode)
    centres = np.array(kept)
    return np.array([int(np.argmin(np.hypot(*(centres - p).T))) for p in points], np.int64)
