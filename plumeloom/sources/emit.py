"""Scenes from spectrometer files: NetCDF through Spark's data source API, spectra and models.

netCDF4 is optional: without it, registering works and reading says what is missing. Raw tables in
Parquet with the same columns go through the same operators (scene_from_raw).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumeloom.functions import geo
from plumeloom.operators.masks import filled, is_valid, without_fill
from plumeloom.operators.ortho import orthorectified

FILL = -9999.0
#: Where the zenith angles stand among the observation bands.
SENSOR_ZENITH, SUN_ZENITH = 2, 4
ROWS_A_PART = 16
RAW = "granule_id string, downtrack int, crosstrack int, values array<float>"
#: Names in the files.
RADIANCE, OBSERVATIONS, GLT_X, GLT_Y, ELEVATION = "radiance", "obs", "location/glt_x", "location/glt_y", "location/elev"
WAVELENGTHS, WIDTHS = "sensor_band_parameters/wavelengths", "sensor_band_parameters/fwhm"
NOT_A_RASTER = "flat_field_update"
RAD, OBS = "_L1B_RAD", "_L1B_OBS"


def opened(path: str):
    try:
        import netCDF4
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs the netCDF4 package on every executor") from e
    return netCDF4.Dataset(path)


class RawRows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class RawReader(DataSourceReader):
    """A variable of two dimensions, or of (downtrack, crosstrack, band), in blocks of rows; each task
    reads its own and hands it on as Arrow, without a Python object per value."""

    def __init__(self, options: dict) -> None:
        self.path, self.variable = options["path"], options.get("variable", RADIANCE)
        self.granule = options.get("granule_id") or granule_of(self.path)

    def partitions(self):
        with opened(self.path) as ds:
            rows = ds[self.variable].shape[0]
        return [RawRows(k, min(rows, k + ROWS_A_PART)) for k in range(0, rows, ROWS_A_PART)]

    def read(self, part: RawRows):
        with opened(self.path) as ds:
            block = np.ma.filled(np.ma.asarray(ds[self.variable][part.first : part.last]).astype(np.float32), FILL)
        block = block.reshape(*block.shape[:2], -1)
        rows, columns, bands = block.shape
        flat = block.ravel()
        values = pa.array(flat, pa.float32(), mask=(flat == FILL) | np.isnan(flat))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows * columns + 1) * bands, pa.int32()), values)
        y, x = np.divmod(np.arange(rows * columns), columns)
        ids = pa.array([self.granule], pa.string()).take(pa.array(np.zeros(len(y), np.int32)))
        yield pa.RecordBatch.from_arrays([ids, pa.array((y + part.first).astype(np.int32)), pa.array(x.astype(np.int32)), lists], names=["granule_id", "downtrack", "crosstrack", "values"])


class EmitSource(DataSource):
    """spark.read.format("emit").option("variable", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "emit"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EmitSource)


def granule_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def facts(path: str) -> dict:
    """What a scene's file says of the whole: shape, geotransform, spatial_ref, wavelengths, widths (null
    where it says nothing) and the names of its rasters. Only these few numbers are read."""
    with opened(path) as ds:
        have = lambda name: np.ma.filled(np.ma.asarray(ds[name][:]).astype(float), np.nan).tolist() if _has(ds, name) else None
        h, w = ds[GLT_X].shape[:2]
        transform = [float(x) for x in getattr(ds, "geotransform", (0.0, 60.0, 0.0, 0.0, 0.0, -60.0))]
        rasters = [n for n, v in ds.variables.items() if len(v.shape) in (2, 3) and n != NOT_A_RASTER]
        return {"h": h, "w": w, "geotransform": transform, "spatial_ref": getattr(ds, "spatial_ref", None), "wavelengths": have(WAVELENGTHS), "widths": have(WIDTHS), "rasters": rasters}


def _has(ds, name: str) -> bool:
    try:
        ds[name]
    except (KeyError, IndexError):
        return False
    return True


def observation_path(path: str) -> str:
    """The observation file beside a radiance file; other names are an error."""
    if RAD not in path:
        raise ValueError(f"not a radiance file: {path}")
    return path.replace(RAD, OBS)


def variable(spark: SparkSession, path: str, name: str, granule_id: str | None = None) -> DataFrame:
    register(spark)
    return spark.read.format("emit").option("variable", name).option("granule_id", granule_id or granule_of(path)).load(path)


def lookup_table(spark: SparkSession, path: str) -> DataFrame:
    """granule_id, gy, gx, glt_x, glt_y."""
    at = lambda name, c: variable(spark, path, name).select("granule_id", F.col("downtrack").alias("gy"), F.col("crosstrack").alias("gx"), F.get("values", F.lit(0)).cast("int").alias(c))
    return at(GLT_X, "glt_x").join(at(GLT_Y, "glt_y"), ["granule_id", "gy", "gx"])


def ortho_variables(glt: DataFrame, rasters: dict[str, DataFrame]) -> DataFrame:
    """All raw rasters (granule_id, downtrack, crosstrack, values) of a scene on its grid, by one lookup:
    granule_id, gy, gx and a column of values each, null where there is no data."""
    raw, keys = None, ["granule_id", "downtrack", "crosstrack"]
    for name, df in rasters.items():
        one = df.select(*keys, F.transform("values", lambda v: without_fill(v)).alias(name))
        raw = one if raw is None else raw.join(one, keys, "full")
    return orthorectified(glt, raw, list(rasters))


def scene_from_raw(rad: DataFrame, obs: DataFrame, glt: DataFrame, elev: DataFrame | None = None) -> DataFrame:
    """Orthorectified pixels: granule_id, gy, gx, valid, radiance, sun_zenith, sensor_zenith,
    crosstrack, elevation. rad, obs, elev: granule_id, downtrack, crosstrack, values; one lookup for all."""
    keys = ["granule_id", "downtrack", "crosstrack"]
    obs = obs.select(*keys, *[without_fill(F.get("values", F.lit(k))).alias(n) for k, n in ((SUN_ZENITH, "sun_zenith"), (SENSOR_ZENITH, "sensor_zenith"))])
    clean = F.transform("values", lambda v: without_fill(v))
    raw = rad.select(*keys, clean.alias("radiance"), F.col("crosstrack").cast("float").alias("column")).join(obs, keys, "left")
    if elev is None:
        raw = raw.withColumn("elevation", F.lit(None).cast("float"))
    else:
        raw = raw.join(elev.select(*keys, without_fill(F.get("values", F.lit(0))).alias("elevation")), keys, "left")
    px = orthorectified(glt, raw, ["radiance", "sun_zenith", "sensor_zenith", "column", "elevation"], {"column": FILL})
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("float")
    return px.select("granule_id", "gy", "gx", F.coalesce(is_valid(F.col("radiance")), F.lit(False)).alias("valid"), filled(F.col("radiance")).alias("radiance"), zero("sun_zenith").alias("sun_zenith"), zero("sensor_zenith").alias("sensor_zenith"), F.col("column").alias("crosstrack"), "elevation")


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[float] | None]:
    """A radiance file with the observation file beside it: pixels, granules and the bands' centres."""
    beside, granule, known = observation_path(path), granule_of(path), facts(path)
    parts = [variable(spark, p, name, granule) for p, name in ((path, RADIANCE), (beside, OBSERVATIONS), (path, ELEVATION))]
    pixels = scene_from_raw(parts[0], parts[1], lookup_table(spark, path), parts[2])
    x0, step, _, y0 = known["geotransform"][:4]
    row = [(granule, known["h"], known["w"], x0, y0, abs(step), known["spatial_ref"])]
    granules = zones(spark.createDataFrame(row, "granule_id string, h int, w int, x0 double, y0 double, scale double, spatial_ref string"))
    return pixels, granules, known["wavelengths"]


def zones(granules: DataFrame) -> DataFrame:
    """Add epsg and zone from spatial_ref and the upper left corner (x0, y0)."""
    return granules.withColumn("epsg", geo.epsg_of(F.col("spatial_ref"), F.col("x0"), F.col("y0"))).withColumn("zone", geo.zone_of(F.col("epsg")))


def gas_samples(path: str, bands: list[tuple[int, str, float]], gas: str, sensor: str = "emit_l1b") -> tuple[list[tuple], float]:
    """Per band (number, name, centre): responses and transmittances with and without the gas, and
    the ppm m that the gas samples add, from an npz of fixed size. Pickled contents are refused."""
    sensor = {"enmap_l1c": "enmap_l1b"}.get(sensor, sensor)
    with np.load(path, allow_pickle=False) as f:
        get = lambda name, kind, what: np.atleast_1d(f[f"{sensor}_{name}_{kind}_{what}"])
        rows = [(k, c, get(n, "none", "spectral_responses"), get(n, "none", "transmittances"), get(n, gas, "transmittances")) for k, n, c in bands]
        added = get(bands[0][1], gas, "spectral_data_added_ppm-m") if bands else np.empty(0)
    return rows, float(added[0]) if len(added) else 0.0


@functools.cache
def loaded_model(factory, path: str):
    """A model, loaded once per worker; any failure is a ValueError that names the path."""
    try:
        return factory(path)
    except Exception as e:
        raise ValueError(f"no model could be loaded from {path}") from e
