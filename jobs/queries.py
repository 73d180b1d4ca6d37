"""The jobs as queries: each is run twice into one new folder, and what stands there then is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import product_catalogue, scene_plumes
from plumeloom.plans.storage import shared_dir


def job1_product_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/{product_catalogue.NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        product_catalogue.run(spark, f"{sf_dir}/pages.parquet", out)
    return product_catalogue.read(spark, out).drop("shard")


def job2_scene_plumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/{scene_plumes.NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        scene_plumes.run(spark, f"{sf_dir}/events.parquet", f"{base}/out", f"{base}/checkpoint")
    return scene_plumes.read(spark, f"{base}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_product_catalogue, job2_scene_plumes)}


def oracle_sql() -> dict[str, str]:
    return {"job1_product_catalogue": product_catalogue.SQL, "job2_scene_plumes": scene_plumes.SQL}
