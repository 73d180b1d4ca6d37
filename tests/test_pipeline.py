import pytest
from pyspark.sql import functions as F

from plumeloom import catalog
from plumeloom.config import Settings
from plumeloom.plans import pipeline
from plumeloom.plans.metrics import Counters
from plumeloom.plans.storage import written

SF = "/root/testdata/sf0.001"
SMALL = Settings(tile_size=4, stride=2, plume_threshold=0.5, origin_threshold=0.4, clustering="DBSCAN", clustering_kw={"eps": 1.5, "min_samples": 1}, cc_min_size=1, simplify=0.0, vetting_patch=4, scale=1.0)


@pytest.fixture(scope="module")
def scene(spark):
    """Two scenes of 8 x 8: plume A (2 x 2, head at 3, 3) in all tiles that cover it, plume B (one pixel) at 6, 6."""
    px = spark.range(2).withColumnRenamed("id", "granule_id").crossJoin(spark.range(8).withColumnRenamed("id", "gy")).crossJoin(spark.range(8).withColumnRenamed("id", "gx"))
    px = px.withColumns({"h": F.lit(8), "w": F.lit(8), "valid": F.lit(True)})
    a = F.col("gy").between(3, 4) & F.col("gx").between(3, 4)
    b = (F.col("gy") == 6) & (F.col("gx") == 6)
    on = px.withColumns({"p_plume": F.when(a | b, 0.9).otherwise(0.1), "p_origin": F.when(((F.col("gy") == 3) & (F.col("gx") == 3)) | b, 0.8).otherwise(0.0), "conc": F.when(a | b, 10.0).otherwise(0.0)})
    from plumeloom.operators.tiling import tiled_pixels

    tiled = tiled_pixels(on, 4, 2)
    slots = tiled.select("granule_id", "h_off", "w_off", F.lit(0).alias("slot_id"), (F.col("gy") - F.col("h_off")).alias("y"), (F.col("gx") - F.col("w_off")).alias("x"), "conc", "p_plume", "p_origin")
    pixels = px.select("granule_id", "gy", "gx", "valid", F.array(F.lit(1.0)).alias("radiance"), F.lit(0.0).alias("sun_zenith"), F.lit(0.0).alias("sensor_zenith"))
    granules = spark.createDataFrame([(0, 8, 8, 300000.0, 4000000.0, "31N"), (1, 8, 8, 300000.0, 4000000.0, "31S")], "granule_id long, h int, w int, x0 double, y0 double, zone string")
    return slots, pixels, granules


def test_two_plumes_a_scene(spark, scene):
    slots, pixels, granules = scene
    counters = Counters()
    found, plumes, image = pipeline.run(slots, pixels, granules, SMALL, counters=counters)
    got = sorted(plumes.collect(), key=lambda r: (r.granule_id, r.head_x))
    assert [(r.granule_id, round(r.head_x), round(r.head_y)) for r in got] == [(0, 3, 3), (0, 6, 6), (1, 3, 3), (1, 6, 6)]
    assert got[0].cluster_size > 1 and got[0].geometry_px.startswith("POLYGON")
    assert 36 < got[0].head_lat < 37 and got[2].head_lat < 0
    assert counters.values() == {"candidates": found.count(), "plumes": 4}
    assert image.count() == 128
    assert image.filter("enhancement > 0").count() == 10


def test_a_scene_without_plumes(spark, scene):
    slots, pixels, granules = scene
    _, plumes, image = pipeline.run(slots.withColumn("p_plume", F.lit(0.0)), pixels, granules, SMALL)
    assert plumes.count() == 0 and image.count() == 128


def test_small_components_go_unless_they_hold_the_origin(spark, scene):
    slots, pixels, granules = scene
    far = Settings(**{**{f: getattr(SMALL, f) for f in SMALL.__dataclass_fields__}, "cc_min_size": 3})
    keep = pipeline.run(slots, pixels, granules, far)[1]
    assert keep.count() == 4
    none = Settings(**{**{f: getattr(far, f) for f in far.__dataclass_fields__}, "keep_origin_component": False})
    assert pipeline.run(slots, pixels, granules, none)[1].count() == 2


def test_sweep_tags_its_settings(spark, scene):
    slots, pixels, granules = scene
    placed = written(pipeline.with_place(slots, pixels), "placed")
    high = Settings(**{**{f: getattr(SMALL, f) for f in SMALL.__dataclass_fields__}, "plume_threshold": 0.95})
    got = pipeline.swept(placed, granules, [SMALL, high]).groupBy("plume_prob").count().collect()
    assert {r.plume_prob for r in got} == {0.5}


@pytest.mark.parametrize("name", ["extract_candidates", "pipeline_e2e", "meanshift", "mask_wkt", "utm_corners", "assign_hungarian", "fit_conc"])
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_scene_queries_take_every_row_of_the_raster(spark, tmp_path):
    """A raster of 120 rows: each of the queries reaches its end, and the slots are those of a plain count."""
    width, size, stride = 100, catalog.TILE, catalog.STRIDE
    rows = spark.range(120 * width).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"), ((F.col("id") * 37) % 1000 / 100.0).alias("value"), F.when(F.col("id") % 11 == 0, "error").otherwise("click").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    hit = {(r.gy, r.gx) for r in catalog.raster(spark, str(tmp_path)).filter("p > 400 AND valid").collect()}
    want = {(y, x) for y in range(0, 120 - size + 1, stride) for x in range(0, width - size + 1, stride) if sum((y + j, x + k) in hit for j in range(size) for k in range(size)) >= 3}
    assert max(want)[0] > 60
    found = catalog.queries()["extract_candidates"](spark, str(tmp_path)).select("plume_bbox_px").collect()
    assert {(r[0][1], r[0][0]) for r in found} == want and len(found) == len(want)
    plumes = catalog.queries()["dedupe_plumes"](spark, str(tmp_path)).collect()
    assert max(r.y1 for r in plumes) > 100
    assert catalog.queries()["pipeline_e2e"](spark, str(tmp_path)).count() == len(plumes)


def test_no_table_of_a_run_passes_the_driver(spark, tmp_path):
    """Patches of spectra, and whatever else grows with the scenes, are joined by shuffle: a table that were broadcast by place or plume would be over the limit."""
    rows = spark.range(24 * 100).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"), ((F.col("id") * 37) % 1000 / 100.0).alias("value"), F.when(F.col("id") % 11 == 0, "error").otherwise("click").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # a table of one scene is 1 MB, one of several keys takes a page of more
    try:
        found = catalog.queries()["pipeline_e2e"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(found) > 0 and any(r.observed_transmittance_sel for r in found)


def test_scenes_are_broadcast_and_not_what_lies_on_them(spark):
    """Where all rows are of one constant scene, a join by scene has no key left, and the side that a plan takes for the smaller is broadcast."""
    one = F.lit(0).cast("long").alias("granule_id")
    granules = spark.range(100_000).filter("id < 1").select(one, *[F.lit(v).alias(n) for n, v in (("h", 8), ("w", 8), ("x0", 300000.0), ("y0", 4000000.0), ("zone", "31N"))])
    px = spark.range(64).select(one, F.expr("id div 8").alias("gy"), F.expr("id % 8").alias("gx"), F.lit(True).alias("valid"), F.col("id").alias("v"))
    boxes = spark.range(64).select(one, *[F.col("id").alias(c) for c in ("x0", "y0")], *[(F.col("id") + 4).alias(c) for c in ("x1", "y1")])
    for df in (pipeline.tiled_inference(px, granules, catalog.mock_model, "", 4, 2, {"v": "v"}), pipeline._georeferenced(boxes, granules, SMALL)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan


def test_fit_query_finds_what_was_planted(spark):
    want = {r.o_orderkey: r.o_orderkey % 251 for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for r in catalog.queries()["fit_conc"](spark, SF).collect():
        assert abs(r.fitted_conc - want[r.plume_id]) < 0.05


def test_fit_query_fits_every_order(spark):
    ids = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    got = [r.plume_id for r in catalog.queries()["fit_conc"](spark, SF).collect()]
    assert len(got) == len(ids) and set(got) == ids


def test_command_line(spark, scene, tmp_path):
    from plumeloom.__main__ import keywords, main
    from plumeloom.plans.outputs import save_npy

    assert keywords("eps=1.5:min_samples=1:a=x:b=None:c=true") == {"eps": 1.5, "min_samples": 1, "a": "x", "b": None, "c": True}
    with pytest.raises(ValueError):
        keywords("a")
    for name, df in zip(("slots", "pixels", "granules"), scene, strict=True):
        df.write.parquet(str(tmp_path / name))
    paths = [x for n in ("slots", "pixels", "granules", "out") for x in (f"--{n}", str(tmp_path / n))]
    main([*paths, "--tile-size", "4", "--stride", "2", "--scale", "1", "--cc-min-size", "1", "--clustering", "DBSCAN", "--clustering-kw", "eps=1.5:min_samples=1"], spark)
    assert spark.read.parquet(str(tmp_path / "out/predicted")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/candidates")).count() > 4
    image = spark.read.parquet(str(tmp_path / "out/enhancement"))
    save_npy(image, 0, str(tmp_path / "image.npy"))
    import numpy as np

    assert (np.load(tmp_path / "image.npy") > 0).sum() == 5
