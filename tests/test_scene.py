"""From a scene's files, or its pixels, through a model to candidates and plumes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import found
import stand_in
from plumeloom import schema
from plumeloom.config import Settings
from plumeloom.functions import geo
from plumeloom.plans import inference, metrics, pipeline
from plumeloom.sources import bands, emit

SMALL = {"tile_size": 8, "stride": 4, "clustering": "DBSCAN", "clustering_kw": {"eps": 1.5, "min_samples": 1}, "cc_min_size": 1, "simplify": 0.0, "vetting_patch": 4}
needs_stub = pytest.mark.skipif(found.HAS_NETCDF, reason="files of the stand-in are no NetCDF")


def raster(spark, h, w, valid="true", granule="1"):
    px = spark.range(h * w).select(F.expr(f"CAST({granule} AS BIGINT)").alias("granule_id"), F.expr(f"id div {w}").alias("gy"), F.expr(f"id % {w}").alias("gx"))
    px = px.withColumn("valid", F.expr(valid))
    return px.withColumns({"radiance": F.array(*[F.col(c).cast("float") for c in ("gy", "gx")], F.lit(1.0)), "sun_zenith": F.lit(3.0)})


def sizes(spark, rows):
    return spark.createDataFrame(rows, "granule_id long, h int, w int")


@pytest.mark.parametrize("h,w,size,stride,valid,n", [(100, 100, 64, 32, "true", 4), (64, 64, 64, 64, "true", 1), (64, 64, 64, 64, "false", 0), (63, 64, 64, 64, "true", 0), (40, 52, 8, 4, "gy < 4 AND gx < 4", 1), (40, 52, 8, 4, "gy = 39", 12)])
def test_tiles_that_reach_the_model(spark, h, w, size, stride, valid, n):
    got = inference.tiled_inference(raster(spark, h, w, valid), sizes(spark, [(1, h, w)]), stand_in.model_of, "m", size, stride)
    assert got.select("h_off", "w_off").distinct().count() == n and got.count() == n * size * size


@pytest.mark.parametrize("side", [1, 3, 4])
def test_every_tile_holds_its_own_pixels(spark, side):
    px = raster(spark, 30, 41).unionByName(raster(spark, 12, 9, granule="2"))
    got = inference.tiled_inference(px, sizes(spark, [(1, 30, 41), (2, 12, 9), (3, 5, 5)]), stand_in.model_of, "m", 8, 4, side=side).collect()
    assert len(got) == (6 * 9 + 2 * 1) * 64 == len({(r.granule_id, r.h_off, r.w_off, r.y, r.x) for r in got})
    assert all((r.p_plume, r.p_origin, r.conc, r.slot_id) == (r.h_off + r.y, r.w_off + r.x, 1.0, 0) for r in got)


def test_pixels_without_rows_or_spectra_are_zero(spark):
    px = raster(spark, 8, 8).filter("gx <> 5").withColumn("radiance", F.when(F.col("gy") == 2, F.array().cast("array<double>")).when(F.col("gy") == 3, F.lit(None)).otherwise(F.col("radiance")))
    got = inference.tiled_inference(px, sizes(spark, [(1, 8, 8)]), stand_in.model_of, "m", 8, 8).collect()
    assert len(got) == 64 and all(r.conc == (0.0 if r.x == 5 or r.y in (2, 3) else 1.0) for r in got)


def test_a_model_that_does_not_load(spark):
    with pytest.raises(Exception, match="no model could be loaded from missing"):
        inference.tiled_inference(raster(spark, 8, 8), sizes(spark, [(1, 8, 8)]), stand_in.model_of, "missing", 8, 8).count()


def files(folder, h=24, w=20):
    """A radiance and an observation file of raw places that the lookup table turns upside down."""
    light = np.ones((h, w, 4), np.float32)
    light[..., :3] = 0.1
    light[10:13, 8:11, 0], light[11, 9, 1], light[10:13, 8:11, 2] = 0.9, 0.8, 12.0
    light[0, 0, 3] = -9999.0
    at_y, at_x = np.meshgrid(np.arange(h, 0, -1, dtype=np.int32), np.arange(1, w + 1, dtype=np.int32), indexing="ij")
    at_y[5, 5] = 0
    facts = json.dumps({"geotransform": [300000.0, 60.0, 0.0, 4000000.0, 0.0, -60.0], "spatial_ref": "EPSG:32631"})
    more = {"location|glt_x": at_x, "location|glt_y": at_y, "location|elev": np.arange(h * w, dtype=np.float32).reshape(h, w), "sensor_band_parameters|wavelengths": np.array([500.0, 1650.0, 2200.0, 2300.0])}
    path = str(folder / "EMIT_L1B_RAD_001.npz")
    np.savez(path, radiance=light, flat_field_update=np.ones((h, w)), attributes=np.array(facts), **more)
    angles = np.zeros((h, w, 6), np.float32)
    angles[..., 2], angles[..., 4] = 5.0, 30.0
    np.savez(emit.observation_path(path), obs=angles, attributes=np.array(facts), **more)
    return path, light


@needs_stub
def test_reading_a_scene(spark, tmp_path):
    path, light = files(tmp_path)
    pixels, granules, centres = emit.read_scene(spark, path)
    assert centres == [500.0, 1650.0, 2200.0, 2300.0] and emit.facts(path)["rasters"] == ["radiance"]
    g = granules.first()
    assert (g.granule_id, g.h, g.w, g.x0, g.y0, g["scale"], g.epsg, g.zone) == ("EMIT_L1B_RAD_001", 24, 20, 300000.0, 4000000.0, 60.0, "EPSG:32631", "31N")
    got = {(r.gy, r.gx): r for r in pixels.collect()}
    assert len(got) == 480 and {i for i, r in got.items() if not r.valid} == {(5, 5), (23, 0)}
    for (y, x), r in got.items():
        if (y, x) != (5, 5):
            raw = light[23 - y, x].copy()
            raw[raw == -9999.0] = 0.0
            assert r.radiance == raw.tolist() and (r.sensor_zenith, r.sun_zenith, r.crosstrack, r.elevation) == (5.0, 30.0, x, (23 - y) * 20 + x)
    assert got[5, 5].crosstrack == -9999.0 and got[5, 5].elevation is None
    glt = emit.lookup_table(spark, path)
    both = emit.ortho_variables(glt, {"radiance": emit.variable(spark, path, "radiance"), "elev": emit.variable(spark, path, "location/elev")}).filter("gy = 23 AND gx < 2").orderBy("gx").collect()
    assert both[0].radiance[3] is None and both[1].elev == [1.0] and len(both[1].radiance) == 4
    with pytest.raises(ValueError, match="not a radiance file"):
        emit.read_scene(spark, str(tmp_path / "other.nc"))


@needs_stub
def test_command_line_on_a_file(spark, tmp_path, capsys):
    from plumeloom.__main__ import main, parser, settings

    path, _ = files(tmp_path)
    base = ["--input", path, "--model", "m", "--factory", "stand_in:model_of", "--tile-size", "8", "--stride", "4", "--cc-min-size", "1", "--clustering", "DBSCAN", "--clustering-kw", "eps=1.5:min_samples=1"]
    main([*base, "--out", str(tmp_path / "out"), "--rasters", "--count", "--window", "tukey"], spark)
    said = dict(line.split(": ") for line in capsys.readouterr().out.splitlines() if ": " in line)
    plumes = spark.read.parquet(str(tmp_path / "out/predicted")).collect()
    assert len(plumes) == 1 and plumes[0].head_point_px.startswith("POINT (9.0000000000000000 12.0")
    found = spark.read.parquet(str(tmp_path / "out/candidates")).collect()
    assert len(found) > 1 and all(len(r.concentration) == len(r.binary_mask) == len(r.origin_mask) == len(r["mask"]) == 64 for r in found)
    assert said["plumes"] == "1" and said["candidates"] == said["extracted"] == str(len(found)) and int(said["chunks"]) > 0
    x0, y0, x1, y1 = plumes[0].raster_bbox_px
    assert len(plumes[0].concentration) == len(plumes[0].plume_probability) == len(plumes[0].origin_probability) == (x1 - x0) * (y1 - y0) and max(plumes[0].concentration) > 0
    assert all(sum(r.binary_mask) == round(sum(c == 12.0 for c in r.concentration)) for r in found)
    main([*base, "--out", str(tmp_path / "crop"), "--crop", "8"], spark)
    assert spark.read.parquet(str(tmp_path / "crop/enhancement")).count() == 64
    with pytest.raises(SystemExit):
        main(["--out", "x"], spark)
    s = settings(parser().parse_args([*base[:6], "--out", "x", "--eps-dist", "3", "--most-in-cluster", "2", "--drop-origin-component"]))
    assert s.clustering_kw["eps_dist"] == 3.0 and s.clustering_kw["patch_size"] == 65 and s.most_in_cluster == 2 and not s.keep_origin_component
    with pytest.raises(ValueError, match="window"):
        Settings(window="x")


def test_everything_that_a_run_counts(spark):
    px = raster(spark, 16, 16, "gy < 12").withColumn("radiance", F.expr("array(CAST(CASE WHEN gy BETWEEN 4 AND 6 AND gx IN (3, 4, 9) THEN 0.9 ELSE 0 END AS FLOAT), CAST(CASE WHEN gy = 5 AND gx IN (3, 9) THEN 0.8 ELSE 0 END AS FLOAT), CAST(gy * gy + gx * 3 AS FLOAT))"))
    granules = sizes(spark, [(1, 16, 16)]).withColumns({"x0": F.lit(300000.0), "y0": F.lit(4000000.0), "zone": F.lit("31N")})
    counters = metrics.Counters(metrics.EVERYTHING)
    s = Settings(**{**SMALL, "clustering": "DBSCANCorr", "clustering_kw": {"eps_dist": 3.0, "eps_corr": 0.5, "min_samples": 1, "patch_size": 3}})
    found, plumes, _ = pipeline.run_scene(px, granules, s, stand_in.model_of, "m", counters=counters, rasters=True)
    n = plumes.count()
    got = counters.values()
    assert got["chunks"] == 9 and got["extracted"] == got["candidates"] == found.count() and got["plumes"] == n == 2 and got["no_valid_mask"] >= 0
    assert schema.candidates(found, rasters=True).columns[-4:] == ["concentration", "binary_mask", "origin_mask", "mask"]


def test_stacked_rasters(spark):
    px = spark.createDataFrame([(1, 0, y, x, float(10 * y + x), 0.5, 0.25, True) for y in (4, 5) for x in (7, 8, 9)], "granule_id long, group_id long, gy long, gx long, conc double, p_plume double, p_origin double, hit boolean")
    r = pipeline.stacked(pipeline.Plumes(px, px)).first()
    assert (r.x0, r.y0, r.width, r.height) == (7, 4, 3, 2) and [v.conc for v in r.raster] == [47.0, 48.0, 49.0, 57.0, 58.0, 59.0] and r.raster[0].p_origin == 0.25


def test_bands_come_with_the_file(spark):
    given = [500.0, 1650.5, 2150.25, 2300.125, 2440.0]
    assert [(r.band, r["name"], r.centre, r.width) for r in bands.catalogue(spark, given, [8.5] * 5).collect()] == [(k, f"radiance_{k}", c, 8.5) for k, c in enumerate(given)]
    assert bands.chosen("methane", given) == ([(2, "radiance_2", 2150.25), (3, "radiance_3", 2300.125), (4, "radiance_4", 2440.0)], [0])
    assert len(bands.centres()) == 285 and bands.centres()[0] == 381.0 and all(round(b - a, 6) == 7.45 for a, b in zip(bands.centres(), bands.centres()[1:], strict=False))
    with pytest.raises(ValueError):
        bands.chosen("steam")


@pytest.mark.parametrize("lat,lon,zone", [(60.0, 5.0, "32V"), (60.0, 2.0, "31V"), (78.0, 8.0, "31X"), (78.0, 20.0, "33X"), (78.0, 41.9, "37X"), (-33.0, 151.0, "56H"), (0.0, 179.9, "60N"), (83.9, -10.0, "29X"), (-79.9, -180.0, "1C")])
def test_grids_about_places(spark, lat, lon, zone):
    g = geo.grid_about(F.lit(lat), F.lit(lon), 60.0, 10, 20, down=True)
    r = spark.range(1).select(*[c.alias(k) for k, c in g.items()], geo.grid_transform(g["x0"], g["y0"], F.lit(20), 60.0).alias("t")).first()
    assert r.zone == zone and r.epsg == f"EPSG:32{6 if lat >= 0 else 7}{int(zone[:-1]):02}"
    assert r.t == [60.0, 0.0, r.x0, 0.0, -60.0, r.y0 + 1200.0] and r.x_mid == r.x0 + 300 and r.y_mid == r.y0 + 600 and r.x0 % 60 == 0
