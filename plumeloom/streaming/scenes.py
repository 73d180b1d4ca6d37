"""Scenes as they arrive: a file stream of slot pixels, each batch run as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run work on every batch that is there now and write its result once per batch.

    A batch that is run again after a failure overwrites its own folder, so results are not doubled.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plume_counts(stream: DataFrame, threshold: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pixels over a threshold per scene and event-time window (column ts), with late rows let in."""
    hits = stream.withWatermark("ts", late).filter(F.col("p_plume") > threshold)
    return hits.groupBy(F.window("ts", width), "granule_id").agg(F.count("*").alias("n_pixels"))
