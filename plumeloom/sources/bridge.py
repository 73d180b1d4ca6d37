"""Small rasters, lookups and spectra derived from a star schema's tables, in whole numbers, so that
any SQL engine derives the same ones. The SQL of each stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE, STRIDE = 8, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """granule_id, gy, gx, v, valid, p (per mille), o (per mille), h, w: scenes 100 pixels wide."""
    e = table(spark, sf_dir, "events")
    px = e.select(
        F.lit(0).cast("long").alias("granule_id"),
        F.expr("event_id div 100").alias("gy"),
        F.expr("event_id % 100").alias("gx"),
        F.expr("CAST(round(value * 100) AS BIGINT)").alias("v"),
        (F.col("event_type") != "error").alias("valid"),
        F.expr("CASE WHEN (((event_id % 100) div 4) * 31 + (event_id div 400) * 17) % 7 < 2 THEN 500 ELSE 0 END + ((event_id * 7919 + user_id * 104729) % 1000) div 3").alias("p"),
        F.expr("(event_id * 31 + user_id * 17) % 1000").alias("o"),
    )
    size = px.groupBy("granule_id").agg((F.max("gy") + 1).alias("h"), (F.max("gx") + 1).alias("w"))
    return px.join(F.broadcast(size), "granule_id")  # one row a scene


RASTER_SQL = """px AS (SELECT 0::BIGINT AS granule_id, event_id // 100 AS gy, event_id % 100 AS gx, CAST(round(value * 100) AS BIGINT) AS v, event_type <> 'error' AS valid,
  CASE WHEN (((event_id % 100) // 4) * 31 + (event_id // 400) * 17) % 7 < 2 THEN 500 ELSE 0 END + ((event_id * 7919 + user_id * 104729) % 1000) // 3 AS p,
  (event_id * 31 + user_id * 17) % 1000 AS o, max(event_id // 100) OVER () + 1 AS h, max(event_id % 100) OVER () + 1 AS w FROM events)"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """granule_id, id, x, y: the board grows with the heads, so that they stand equally close at any scale."""
    c = table(spark, sf_dir, "customer")
    span = c.agg(F.expr("greatest(max(c_custkey) * 4 div 15, 4)")).first()[0]
    return c.select(F.lit(0).cast("long").alias("granule_id"), F.col("c_custkey").alias("id"), F.expr("(c_custkey * 37 + c_nationkey * 11) % 100").alias("x"), F.expr(f"(c_custkey * 13) % {span} + c_nationkey % 5").alias("y"))


HEADS_SQL = "heads AS (SELECT 0::BIGINT AS granule_id, c_custkey AS id, (c_custkey * 37 + c_nationkey * 11) % 100 AS x, (c_custkey * 13) % (SELECT greatest(max(c_custkey) * 4 // 15, 4) FROM customer) + c_nationkey % 5 AS y FROM customer)"


def tiles_of_pixels_sql(size: int = TILE, stride: int = STRIDE) -> str:
    """CTE tp: px once per tile that covers it."""
    return f"""ty AS (SELECT *, unnest(range(0, h - {size} + 1, {stride})) AS h_off FROM px), tx AS (SELECT *, unnest(range(0, w - {size} + 1, {stride})) AS w_off FROM ty WHERE gy >= h_off AND gy < h_off + {size}),
  tp AS (SELECT * FROM tx WHERE gx >= w_off AND gx < w_off + {size})"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plume_id, y, x, spectrum (whole numbers), enhancement, plume: patches of 250 pixels, one a plume."""
    e = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda v: F.rint(v * 1000).cast("long"))
    return e.select(F.expr("vec_id div 250").alias("plume_id"), F.expr("vec_id % 250 div 25").alias("y"), F.expr("vec_id % 25").alias("x"), values.alias("spectrum"), F.expr("(vec_id * 7919) % 1009").cast("double").alias("enhancement"), (F.col("label") < 2).alias("plume"))


SPECTRA_SQL = "sp AS (SELECT vec_id // 250 AS plume_id, vec_id % 250 // 25 AS y, vec_id % 25 AS x, list_transform(embedding, lambda v: CAST(round_even(v::DOUBLE * 1000, 0) AS BIGINT)) AS spectrum, CAST((vec_id * 7919) % 1009 AS DOUBLE) AS enhancement, label < 2 AS plume FROM embeddings)"
