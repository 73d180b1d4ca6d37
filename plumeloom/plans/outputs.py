"""What a run writes: candidates, plumes and the enhancement image."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumeloom import schema


def save(candidates: DataFrame, plumes: DataFrame, image: DataFrame, folder: str, strict: bool = False, rasters: bool = False) -> None:
    """Three Parquet tables in a folder, each in place of an older one. rasters: of candidates and plumes, with them."""
    schema.candidates(candidates, rasters).write.mode("overwrite").parquet(f"{folder}/candidates")
    schema.predicted(plumes, strict, rasters).write.mode("overwrite").parquet(f"{folder}/predicted")
    image.write.mode("overwrite").partitionBy("granule_id").parquet(f"{folder}/enhancement")


def save_npy(image: DataFrame, granule_id, path: str) -> None:
    """One scene's image as a dense array in a local file, for viewers; the scene must fit the driver."""
    import numpy as np

    px = image.filter(image["granule_id"] == granule_id).select("gy", "gx", "enhancement").toPandas()
    dense = np.zeros((px["gy"].max() + 1, px["gx"].max() + 1) if len(px) else (0, 0), np.float32)
    dense[px["gy"], px["gx"]] = px["enhancement"]
    np.save(path, dense)
