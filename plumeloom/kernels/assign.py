"""Cheapest one-to-one assignment, by shortest augmenting paths over whole columns."""

from __future__ import annotations

import numpy as np


def assigned(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the columns they take, for the least total cost; min(rows, columns) pairs.

    Each row in turn grows a shortest path through reduced costs (vectorised over columns) and
    flips it, after which prices of rows and columns keep all reduced costs at 0 or more.
    """
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assigned(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner, takes = np.full(m, -1), np.full(n, -1)
    for first in range(n):
        reach, via = np.full(m, np.inf), np.full(m, -1)
        done, row, spent, seen = np.zeros(m, bool), first, 0.0, [first]
        while True:
            through = spent + cost[row] - row_price[row] - column_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], row
            free = np.where(done, np.inf, reach)
            column = int(np.argmin(free))
            spent = float(free[column])
            done[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
            seen.append(row)
        row_price[first] += spent
        for r in seen[1:]:
            row_price[r] += spent - reach[takes[r]]
        column_price[done] -= spent - reach[done]
        while True:
            row = int(via[column])
            owner[column] = row
            column, takes[row] = takes[row], column
            if row == first:
                break
    return np.arange(n), takes
