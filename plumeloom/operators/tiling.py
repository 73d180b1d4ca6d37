"""Tiles over scenes: the grid, which tiles survive, pixels of tiles, and crops.

A scene is a row (granule_id, h, w); a pixel is a row (granule_id, gy, gx, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.plans.storage import shuffled


def _offsets(dim: Column, size: int, stride: int) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(dim >= size, F.sequence(F.lit(0).cast("long"), dim.cast("long") - size, F.lit(stride).cast("long"))).otherwise(none)


def tile_grid(granules: DataFrame, size: int, stride: int) -> DataFrame:
    """granule_id, h_off, w_off of every tile that lies whole in its scene.

    What is left over at the right and bottom is not covered; a scene smaller than a tile has none.
    """
    down = granules.select("granule_id", "w", F.explode(_offsets(F.col("h"), size, stride)).alias("h_off"))
    return down.select("granule_id", "h_off", F.explode(_offsets(F.col("w"), size, stride)).alias("w_off"))


def tiled_pixels(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """Each pixel once per tile that covers it, with h_off and w_off; needs columns h and w.

    Tiles are a lattice, so the tiles of a pixel follow by arithmetic and no join is needed.
    """

    def covering(at: str, dim: str) -> Column:
        first = F.greatest(F.lit(0).cast("long"), F.expr(f"({at} - {size} + {stride}) div {stride}"))
        first = F.when(F.col(at) < size, F.lit(0).cast("long")).otherwise(first)
        last = F.least(F.expr(f"{at} div {stride}"), F.expr(f"({dim} - {size}) div {stride}"))
        none = F.array().cast("array<bigint>")
        return F.when((F.col(dim) >= size) & (first <= last), F.sequence(first, last)).otherwise(none)

    down = pixels.withColumn("_ty", F.explode(covering("gy", "h")))
    both = down.withColumn("_tx", F.explode(covering("gx", "w")))
    return both.withColumns({"h_off": F.col("_ty") * stride, "w_off": F.col("_tx") * stride}).drop("_ty", "_tx")


def surviving_tiles(tile_pixels: DataFrame, valid: str = "valid") -> DataFrame:
    """Tiles with a valid pixel, numbered within their scene by place: chunk_id."""
    alive = tile_pixels.filter(valid).groupBy("granule_id", "h_off", "w_off").agg(F.count("*").alias("n_valid"))
    by_place = Window.partitionBy("granule_id").orderBy("h_off", "w_off")
    return alive.withColumn("chunk_id", (F.row_number().over(by_place) - 1).cast("long"))


def crop_padded(pixels: DataFrame, boxes: DataFrame, values: list[str]) -> DataFrame:
    """Every place of each box (box_id, granule_id, x0, y0, x1, y1), with 0 where no pixel is."""
    down = boxes.withColumn("gy", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    grid = down.withColumn("gx", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    found = grid.join(shuffled(pixels.select("granule_id", "gy", "gx", *values)), ["granule_id", "gy", "gx"], "left")
    return found.select("box_id", "granule_id", (F.col("gy") - F.col("y0")).alias("y"), (F.col("gx") - F.col("x0")).alias("x"), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def center_crop(pixels: DataFrame, size: int) -> DataFrame:
    """The middle size x size of each scene (columns h, w, x0, y0, scale), renumbered, with its
    origin moved; a scene that is too small stays whole."""
    fits = (F.col("h") >= size) & (F.col("w") >= size)
    top, left = F.expr(f"(h - {size}) div 2"), F.expr(f"(w - {size}) div 2")
    inside = ~fits | (F.col("gy").between(top, top + size - 1) & F.col("gx").between(left, left + size - 1))
    top, left = F.when(fits, top).otherwise(0), F.when(fits, left).otherwise(0)
    moved = {"gy": F.col("gy") - top, "gx": F.col("gx") - left, "x0": F.col("x0") + left * F.col("scale"), "y0": F.col("y0") - top * F.col("scale")}
    moved |= {"h": F.when(fits, F.lit(size)).otherwise(F.col("h")), "w": F.when(fits, F.lit(size)).otherwise(F.col("w"))}
    return pixels.filter(inside).withColumns(moved)


def intersection(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Overlap of two half-open boxes, each (x0, y0, x1, y1), as a struct; null if they only touch."""
    x0, y0 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    x1, y1 = F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def overlapping(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of overlapping boxes of one scene: a_id, b_id and the overlap.

    Both sides (id, granule_id, x0, y0, x1, y1) are dealt to the cells of a coarse grid that they
    touch and met by cell; a pair is kept in the cell of its overlap's first corner alone.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
        df = df.select("granule_id", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        return df.withColumn("cx", spread(f"{name}_x0", f"{name}_x1")).withColumn("cy", spread(f"{name}_y0", f"{name}_y1"))

    corners = lambda n: tuple(f"{n}_{c}" for c in ("x0", "y0", "x1", "y1"))
    met = dealt(a, "a").join(shuffled(dealt(b, "b")), ["granule_id", "cx", "cy"]).withColumn("overlap", intersection(corners("a"), corners("b")))
    own_cell = (F.floor(F.col("overlap.x0") / cell) == F.col("cx")) & (F.floor(F.col("overlap.y0") / cell) == F.col("cy"))
    return met.filter(own_cell).select("granule_id", "a_id", "b_id", "overlap.*")
