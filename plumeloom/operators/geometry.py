"""Outlines of masks: edges, area and bounds in SQL, rings and WKT by a kernel per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeloom.kernels.rings import wkts
from plumeloom.plans.keyed import by_whole_keys


def edges(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Sides of pixels (keys, y, x) that border on no other: keys, y, x and side (N, E, S or W)."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for s, dy, dx in (("N", -1, 0), ("E", 0, 1), ("S", 1, 0), ("W", 0, -1))])
    all_sides = pixels.select(*keys, "y", "x", F.explode(sides).alias("s")).select(*keys, "y", "x", "s.side", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    other = pixels.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    return all_sides.join(other, [*keys, "ny", "nx"], "left_anti").select(*keys, "y", "x", "side")


def area_and_bounds(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def mask_wkt(pixels: DataFrame, keys: list[str], simplify: float = 0.0, keep_holes: bool = False, affine: tuple[str, ...] | None = None) -> DataFrame:
    """keys and geometry (WKT) of pixels (keys, y, x), in pixel coordinates, or in those of an affine."""
    return mask_wkts(pixels, keys, {"geometry": affine or (0, 1, 0, 0, 0, 1)}, simplify, keep_holes)


def mask_wkts(pixels: DataFrame, keys: list[str], affines: dict[str, tuple], simplify: float = 0.0, keep_holes: bool = False) -> DataFrame:
    """keys and one geometry (WKT) of pixels (keys, y, x) per affine (a, b, c, d, e, f), each a column or a number:
    the corner (x, y) stands at (a + b x + c y, d + e x + f y). The mask is traced once.

    A key is one plume or slot, whose pixels are bounded by its tile or cluster.
    """
    columns = sorted({c for affine in affines.values() for c in affine if isinstance(c, str)})
    spec = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", {n} string" for n in affines)

    def trace(px: pa.Table, starts: np.ndarray) -> pa.Table:
        y, x = (px.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        numbers = {c: px.column(c).to_numpy(zero_copy_only=False)[starts].astype(float) for c in columns}
        ends, found = np.append(starts[1:], len(y)), []
        for k, (i, j) in enumerate(zip(starts, ends, strict=True)):
            x0, y0 = int(x[i:j].min()), int(y[i:j].min())
            mask = np.zeros((int(y[i:j].max()) - y0 + 1, int(x[i:j].max()) - x0 + 1), bool)
            mask[y[i:j] - y0, x[i:j] - x0] = True

            def place_of(affine: tuple, k=k, x0=x0, y0=y0):
                a, b, c, d, e, f = (float(numbers[n][k]) if isinstance(n, str) else float(n) for n in affine)
                return lambda x, y: (a + b * (x + x0) + c * (y + y0), d + e * (x + x0) + f * (y + y0))

            found.append(wkts(mask, [place_of(a) for a in affines.values()], simplify, keep_holes))
        texts = [pa.array([w[k] for w in found], pa.string()) for k in range(len(affines))]
        return pa.table([*(px.column(k).take(pa.array(starts)) for k in keys), *texts], names=[*keys, *affines])

    return by_whole_keys(pixels.select(*keys, "y", "x", *columns), keys, trace, spec)


def points_of(outlines: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys, ring and p (an array of points, the last one the first) of every ring of WKT polygons."""
    rings = outlines.select(*keys, F.posexplode(F.regexp_extract_all(geometry, F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("ring", "t"))
    point = lambda p: F.transform(F.split(F.trim(p), " +"), lambda v: v.cast("double"))
    return rings.select(*keys, "ring", F.transform(F.split("t", ","), point).alias("p"))


def crossings(outlines: DataFrame, keys: list[str], geometry: str = "geometry", cell: float = 8.0) -> DataFrame:
    """keys and n_crossings: pairs of sides of one key's polygons that share more than an end; no row for none.

    Sides meet in the cells that their boxes touch, so no pair of distant sides is formed; a pair counts in the
    first cell that both touch.
    """
    spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    sides = points_of(outlines, keys, geometry)
    sides = sides.select(*keys, "ring", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))).alias("k", "s"))
    flat = sides.select(*keys, F.struct("ring", "k").alias("n"), F.col("s.a")[0].alias("ax"), F.col("s.a")[1].alias("ay"), F.col("s.b")[0].alias("bx"), F.col("s.b")[1].alias("by"))
    flat = flat.withColumns({f"{f.__name__[0]}{c}": f(f"a{c}", f"b{c}") for c in "xy" for f in (F.least, F.greatest)})
    at = flat.withColumn("cx", spread("lx", "gx")).withColumn("cy", spread("ly", "gy"))
    names = [c for c in at.columns if c not in (*keys, "cx", "cy")]
    other = at.select(*keys, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in names])
    met = at.join(other, [*keys, "cx", "cy"]).filter("n < o_n AND lx <= o_gx AND o_lx <= gx AND ly <= o_gy AND o_ly <= gy")
    met = met.filter((F.col("cx") == F.floor(F.greatest("lx", "o_lx") / cell)) & (F.col("cy") == F.floor(F.greatest("ly", "o_ly") / cell)))
    turn = lambda a, b, c: F.expr(f"({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x)")
    within = lambda a, b, c: F.expr(f"{c}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {c}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y) AND NOT ({c}x = {a}x AND {c}y = {a}y) AND NOT ({c}x = {b}x AND {c}y = {b}y)")
    corners = [("a", "b", "o_a"), ("a", "b", "o_b"), ("o_a", "o_b", "a"), ("o_a", "o_b", "b")]
    t = [turn(*c) for c in corners]
    crossed = (F.signum(t[0]) * F.signum(t[1]) < 0) & (F.signum(t[2]) * F.signum(t[3]) < 0)
    for u, c in zip(t, corners, strict=True):
        crossed = crossed | ((u == 0) & within(*c))
    same = F.expr("least(ax, bx) = least(o_ax, o_bx) AND greatest(ax, bx) = greatest(o_ax, o_bx) AND ((ax = o_ax AND ay = o_ay AND bx = o_bx AND by = o_by) OR (ax = o_bx AND ay = o_by AND bx = o_ax AND by = o_ay))")
    return met.filter(crossed | same).groupBy(*keys).agg(F.count("*").alias("n_crossings"))
