"""Masks, fills and filters on pixels and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.plans.storage import shuffled


def is_valid(spectrum: Column) -> Column:
    """No band is NaN or null."""
    return ~F.exists(spectrum, lambda x: x.isNull() | F.isnan(x))


def usable(spectrum: Column) -> Column:
    """Every band is finite and some band is not 0."""
    return F.forall(spectrum, finite) & F.exists(spectrum, lambda x: x != 0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def filled(spectrum: Column) -> Column:
    """NaN and null become 0; values become float."""
    return F.transform(spectrum, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)).cast("float"))


def without_fill(value: Column, fill: float = -9999.0) -> Column:
    """Null where the file says no data, or has NaN: a raw NaN compares as larger than any number."""
    return F.when((value != fill) & ~F.isnan(value), value)


def whole_or_null(values: Column) -> Column:
    """The array if all of it is finite, else null."""
    return F.when(F.forall(values, finite), values)


def over_threshold(pixels: DataFrame, p: str, threshold: float, valid: str = "valid") -> DataFrame:
    return pixels.filter((F.col(p) > threshold) & F.col(valid))


def large_slots(hits: DataFrame, least: int) -> DataFrame:
    """Slots (granule_id, chunk_id, slot_id) with enough pixels over the threshold: n_pixels."""
    return hits.groupBy("granule_id", "chunk_id", "slot_id").agg(F.count("*").alias("n_pixels")).filter(F.col("n_pixels") >= least)


def excluded(pixels: DataFrame, windows: DataFrame, reach: int, key: str = "plume_id") -> DataFrame:
    """Pixels of any candidate in the window of `reach` on either side of each plume's head:
    key, y, x in the window. windows: key, granule_id, head_x, head_y; pixels: granule_id, gy, gx.

    Pixels are met by cells as large as the window, of which a window touches four at most.
    """
    size = 2 * reach
    edges = {"y0": F.col("head_y").cast("long") - reach, "x0": F.col("head_x").cast("long") - reach}
    spread = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    windows = windows.withColumns(edges).withColumn("cy", spread("y0")).withColumn("cx", spread("x0"))
    cells = pixels.select("granule_id", "gy", "gx").withColumns({"cy": F.floor(F.col("gy") / size), "cx": F.floor(F.col("gx") / size)})
    met = windows.join(shuffled(cells), ["granule_id", "cy", "cx"]).withColumns({"y": F.col("gy") - F.col("y0"), "x": F.col("gx") - F.col("x0")})
    return met.filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)).select(key, "y", "x").distinct()


def background(patch: DataFrame, exclusion: DataFrame, key: str = "plume_id", valid: str = "valid") -> DataFrame:
    """Valid pixels of each plume's patch (key, y, x) that no candidate holds."""
    return patch.filter(valid).join(shuffled(exclusion), [key, "y", "x"], "left_anti")


def dilated(pixels: DataFrame, within: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """The (2 reach + 1)-squares around pixels (keys, y, x), cut to those of `within`."""
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    around = pixels.select(*keys, "y", "x", F.explode(steps).alias("_dy")).select(*keys, "x", (F.col("y") + F.col("_dy")).alias("y"), F.explode(steps).alias("_dx"))
    around = around.select(*keys, "y", (F.col("x") + F.col("_dx")).alias("x")).distinct()
    return within.join(shuffled(around), [*keys, "y", "x"], "left_semi")


def head_squares(pixels: DataFrame, heads: DataFrame, patch: int, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x) in the odd square about each rounded head (keys, head_x, head_y), with
    their place in it, sy and sx. A missing row is padding. No square for a patch of 0 or less."""
    if patch > 0 and patch % 2 == 0:
        raise ValueError("patch must be odd")
    half = patch // 2
    met = pixels.join(heads.select(*keys, F.rint("head_x").cast("long").alias("_x"), F.rint("head_y").cast("long").alias("_y")), keys)
    met = met.withColumns({"sy": F.col("y") - F.col("_y") + half, "sx": F.col("x") - F.col("_x") + half})
    return met.filter(F.col("sy").between(0, patch - 1) & F.col("sx").between(0, patch - 1)).drop("_x", "_y")
