"""Weights of pixels in tiles and patches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_border(i: Column, j: Column, size: int) -> Column:
    """Falls with the distance from the middle to 0.001 at the border."""
    half = size / 2
    return F.greatest(1 - F.sqrt((i - half) * (i - half) + (j - half) * (j - half)) / half, F.lit(0.001))


def l1_border(i: Column, j: Column, size: int) -> Column:
    """Falls in steps outside a plateau; even sizes only."""
    if size % 2:
        raise ValueError("size must be even")
    half, top = size // 2, size // 4 + 1
    ring = lambda k: F.when(k < half, half - 1 - k).otherwise(k - half)
    level = half - F.greatest(ring(i), ring(j))
    return F.least(level, F.lit(top)) / F.lit(min(half, top))


def flat(i: Column, j: Column, size: int) -> Column:
    return F.lit(1.0)


def hann(i: Column, size: int) -> Column:
    return F.lit(1.0) if size == 1 else 0.5 - 0.5 * F.cos(2 * F.lit(3.141592653589793) * i / (size - 1))


def tukey(i: Column, size: int, alpha: float = 0.2) -> Column:
    """Flat in the middle, with cosine slopes over the outer alpha / 2 on each side."""
    if size == 1 or alpha <= 0:
        return F.lit(1.0)
    if alpha >= 1:
        return hann(i, size)
    edge = int(alpha * (size - 1) // 2)
    slope = lambda k: 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (-1 + 2.0 * k / (alpha * (size - 1)))))
    return F.when(i <= edge, slope(i)).when(i >= size - 1 - edge, slope(size - 1 - i)).otherwise(1.0)


def outer(one, i: Column, j: Column, size: int) -> Column:
    return one(i, size) * one(j, size)


BORDERS = {"l2_dist_avg": l2_border, "l1_border_dist_avg": l1_border, "none": flat}
