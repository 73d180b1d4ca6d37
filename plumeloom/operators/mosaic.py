"""The enhancement mosaic: overlapping tile estimates as one weighted mean per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WEIGHT = 1e-10


def mosaic(slot_pixels: DataFrame, value: str, weight: Column, valid: str = "valid") -> DataFrame:
    """granule_id, gy, gx, enhancement and n_tiles.

    Of a tile's slots the largest value counts; tiles are averaged with the weight, valid pixels
    only. Slots meet inside their tile, so the only shuffles are the two partial aggregates.
    """
    per_tile = slot_pixels.groupBy("granule_id", "h_off", "w_off", "gy", "gx").agg(F.max(value).alias("_v"), F.bool_or(valid).alias("_ok"))
    parts = per_tile.select("granule_id", "gy", "gx", "_v", "_ok", F.when(F.col("_ok"), weight).otherwise(0).alias("_w"))
    return weighted_mean(parts, ["granule_id", "gy", "gx"])


def weighted_mean(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys with enhancement from _v and _w, 0 where no weight is, and n_tiles."""
    sums = parts.groupBy(*keys).agg(F.sum(F.col("_v") * F.col("_w")).alias("_n"), F.sum("_w").alias("_d"), F.count_if(F.col("_w") > 0).alias("n_tiles"))
    return sums.select(*keys, (F.coalesce("_n", F.lit(0)).cast("double") / F.greatest(F.col("_d").cast("double"), F.lit(LEAST_WEIGHT))).alias("enhancement"), "n_tiles")
