"""Orthorectification: a lookup table of cells is a left join to raw pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orthorectified(glt: DataFrame, raw: DataFrame, values: list[str], fill: dict[str, object] | None = None, nodata: int = 0) -> DataFrame:
    """glt (granule_id, gy, gx, glt_x, glt_y) with the values of raw (granule_id, downtrack,
    crosstrack) at (glt_y - 1, glt_x - 1); a fill, or null, where either index is nodata.

    All columns come in one join. A null index is nodata.
    """
    seen = (F.coalesce("glt_x", F.lit(nodata)) != nodata) & (F.coalesce("glt_y", F.lit(nodata)) != nodata)
    cells = glt.select("granule_id", "gy", "gx", F.when(seen, F.col("glt_y") - 1).alias("downtrack"), F.when(seen, F.col("glt_x") - 1).alias("crosstrack"))
    met = cells.join(raw.select("granule_id", "downtrack", "crosstrack", *values), ["granule_id", "downtrack", "crosstrack"], "left")
    fill = fill or {}
    return met.select("granule_id", "gy", "gx", *[F.coalesce(v, F.lit(fill[v])).alias(v) if v in fill else F.col(v) for v in values])
