"""Merging the candidates of a cluster: cap, bounds and weighted mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(candidates: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Candidates of a cluster; those without one, or noise, go."""
    return candidates.filter(F.col(cluster).isNotNull() & (F.col(cluster) != -1))


def capped(candidates: DataFrame, most: int, footprint: str = "n_pixels", order: tuple[str, ...] = ("chunk_id", "slot_id")) -> DataFrame:
    """The `most` largest candidates of each cluster; ties go by tile and slot. cluster_size counts
    what is left."""
    by_size = Window.partitionBy("granule_id", "cluster").orderBy(F.desc(footprint), *order)
    kept = candidates.withColumn("place", F.row_number().over(by_size)).filter(F.col("place") <= most)
    return kept.withColumn("cluster_size", F.count("*").over(Window.partitionBy("granule_id", "cluster")))


def bounds(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes (x0, y0, x1, y1) of a cluster."""
    return candidates.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def merged(pixels: DataFrame, keys: list[str], values: list[str], weight: Column, regularizer, valid: str = "valid") -> DataFrame:
    """Per keys and pixel (gy, gx): the weighted mean of each value over valid pixels, pulled to 0
    by the regularizer, and n_support. Sums combine on the map side."""
    w = F.when(F.col(valid), weight).otherwise(F.lit(0))
    parts = pixels.withColumn("_w", w)
    sums = parts.groupBy(*keys, "gy", "gx").agg(F.sum("_w").alias("_d"), F.count_if(F.col(valid)).alias("n_support"), *[F.sum(F.col(v) * F.col("_w")).alias(f"_{v}") for v in values])
    return sums.select(*keys, "gy", "gx", *[(F.col(f"_{v}").cast("double") / (F.lit(regularizer) + F.col("_d")).cast("double")).alias(v) for v in values], "n_support")
