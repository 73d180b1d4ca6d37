"""Connected components (4 neighbours) of a set of pixels."""

from __future__ import annotations

import numpy as np


def labelled(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels from 1 in raster order. Runs of neighbouring rows are merged as they are met, so
    the work grows with the runs, not with the box around the pixels."""
    if not len(y):
        return np.empty(0, np.int64)
    order = np.lexsort((x, y))
    ys, xs = y[order], x[order]
    opens = np.ones(len(ys), bool)
    opens[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(ys)) - 1
    row, left, right = ys[first], xs[first], xs[last]
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0
    for k in range(len(first)):
        while above < k and (row[above] < row[k] - 1 or (row[above] == row[k] - 1 and right[above] < left[k])):
            above += 1
        j = above
        while j < k and row[j] == row[k] - 1 and left[j] <= right[k]:
            a, b = root(j), root(k)
            parent[max(a, b)] = min(a, b)
            j += 1
    roots = np.array([root(k) for k in range(len(first))])
    out = np.empty(len(ys), np.int64)
    out[order] = np.searchsorted(np.unique(roots), roots)[run] + 1
    return out
