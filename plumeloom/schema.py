"""Schemas of the two tables that a run writes, and their forms from plume rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from plumeloom.functions.strings import point_wkt

_FLOATS, _FLAGS, _LONGS = T.ArrayType(T.FloatType()), T.ArrayType(T.BooleanType()), T.ArrayType(T.LongType())


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# The names and kinds of columns that readers of these tables expect, in their order.
CANDIDATE = _fields(
    ("chunk_id", T.LongType()),
    ("slot_id", T.LongType()),
    ("plume_bbox_px", _LONGS),
    ("ee_asset_id", T.StringType()),
    ("geometry_px", T.StringType()),
    ("geometry", T.StringType()),
    ("head_point_px", T.StringType()),
    ("head_point", T.StringType()),
)
CANDIDATE_RASTERS = _fields(("concentration", _FLOATS), ("binary_mask", _FLAGS), ("origin_mask", _FLAGS), ("mask", _FLAGS))
PREDICTED = _fields(
    ("ee_asset_id", T.StringType()),
    ("geometry_px", T.StringType()),
    ("geometry", T.StringType()),
    ("head_point_px", T.StringType()),
    ("head_point", T.StringType()),
    ("ime_emission_rate", T.FloatType()),
    ("cluster_size", T.LongType()),
    ("d_norm", T.FloatType()),
    ("d_cor", T.FloatType()),
    ("fitted_conc", T.FloatType()),
    ("baseline_transmittance", _FLOATS),
    ("observed_transmittance_sel", _FLOATS),
    ("modeled_transmittance", _FLOATS),
    ("wavelengths_sel", _FLOATS),
    ("observed_conc", T.FloatType()),
    ("spectral_vetting_plume_pixels", T.LongType()),
    ("spectral_vetting_background_pixels", T.LongType()),
    ("ime_pixel_area", T.FloatType()),
    ("ime_l_min", T.FloatType()),
    ("ime_l_max", T.FloatType()),
    ("ime_integrated_mass", T.FloatType()),
    ("ime_xp", _FLOATS),
    ("ime_yp", _FLOATS),
    ("hrrr_u_10m", T.FloatType()),
    ("hrrr_v_10m", T.FloatType()),
    ("era5_u_10m", T.FloatType()),
    ("era5_v_10m", T.FloatType()),
)
#: A plume's own raster, where it is wanted: its box, and its layers in row order.
PREDICTED_RASTERS = _fields(("raster_bbox_px", _LONGS), ("concentration", _FLOATS), ("plume_probability", _FLOATS), ("origin_probability", _FLOATS))
#: Columns that come under an older name.
RENAMED = {"hrrr_u_10m": "hrrr_u", "hrrr_v_10m": "hrrr_v", "era5_u_10m": "era5_u", "era5_v_10m": "era5_v"}
VETTING = ("d_norm", "d_cor", "fitted_conc", "baseline_transmittance", "observed_transmittance_sel", "modeled_transmittance", "wavelengths_sel", "observed_conc")


def raster(pixels: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Pixels of each key (y, x) as one array in row order."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", value.alias("v"))))
    return pixels.groupBy(*keys).agg(F.transform(ordered, lambda p: p["v"]).alias(name))


def _as(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a schema: missing columns are null, older names count, other columns go."""

    def column(f: T.StructField) -> Column:
        name = f.name if f.name in df.columns else RENAMED.get(f.name, f.name)
        return (F.col(name) if name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def _pointed(df: DataFrame) -> DataFrame:
    return df.withColumns({"head_point_px": point_wkt(F.col("head_x"), F.col("head_y")), "head_point": point_wkt(F.col("head_lon"), F.col("head_lat")), "ee_asset_id": F.col("granule_id").cast("string")})


def candidates(df: DataFrame, rasters: bool = False) -> DataFrame:
    """Rows with chunk_id, slot_id, x0, y0, x1, y1, geometries and head (null if none) in the
    candidate schema."""
    out = _pointed(df.withColumn("plume_bbox_px", F.array(*[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])))
    return _as(out, T.StructType(CANDIDATE.fields + (CANDIDATE_RASTERS.fields if rasters else [])))


def predicted(df: DataFrame, strict: bool = False, rasters: bool = False) -> DataFrame:
    """Plume rows in the predicted schema; strict: without vetting scores; rasters: with their own."""
    return _as(_pointed(df.drop(*VETTING) if strict else df), T.StructType(PREDICTED.fields + (PREDICTED_RASTERS.fields if rasters else [])))
