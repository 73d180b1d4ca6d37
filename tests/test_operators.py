import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeloom import schema
from plumeloom.config import Settings
from plumeloom.functions import geo, strings, weights
from plumeloom.operators import clusters, components, masks, merging, tiling, vetting
from plumeloom.operators.ortho import orthorectified
from plumeloom.sources import bands, emit


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("h,w,size,stride,n", [(100, 100, 64, 32, 4), (64, 64, 64, 64, 1), (63, 64, 64, 64, 0)])
def test_tile_grid(spark, h, w, size, stride, n):
    g = spark.createDataFrame([(1, h, w)], "granule_id long, h int, w int")
    assert tiling.tile_grid(g, size, stride).count() == n


def block(spark, top, bottom, left, right, **columns):
    rows = spark.range(top, bottom).withColumnRenamed("id", "y").crossJoin(spark.range(left, right).withColumnRenamed("id", "x")).withColumn("granule_id", F.lit(1))
    return rows.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_tiles_without_valid_pixels_go(spark):
    px = block(spark, 0, 8, 0, 8, valid=False, h=8, w=8).withColumnsRenamed({"y": "gy", "x": "gx"})
    assert tiling.surviving_tiles(tiling.tiled_pixels(px, 4, 4)).count() == 0
    half = px.withColumn("valid", F.col("gx") < 4)
    assert [r.chunk_id for r in tiling.surviving_tiles(tiling.tiled_pixels(half, 4, 4)).orderBy("chunk_id").collect()] == [0, 1]


def test_crop_is_padded_with_zero(spark):
    px = block(spark, 0, 10, 0, 10, v=1).withColumnsRenamed({"y": "gy", "x": "gx"})
    boxes = spark.createDataFrame([(7, 1, -2, -2, 8, 8)], "box_id int, granule_id int, x0 int, y0 int, x1 int, y1 int")
    out = tiling.crop_padded(px, boxes, ["v"])
    assert out.count() == 100 and out.agg(F.sum("v")).first()[0] == 64


def test_crop_to_the_middle_keeps_what_is_too_small(spark):
    px = block(spark, 0, 6, 0, 6, h=6, w=6, x0=0.0, y0=0.0, scale=60.0).withColumnsRenamed({"y": "gy", "x": "gx"})
    assert tiling.center_crop(px, 9).count() == 36
    out = tiling.center_crop(px, 2)
    assert out.count() == 4 and out.first()["x0"] == 120.0 and out.first()["y0"] == -120.0


def test_boxes_that_touch_do_not_overlap(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 5, 5), (2, 1, 5, 0, 9, 5), (3, 1, 4, 4, 6, 6), (4, 2, 0, 0, 9, 9)], "id int, granule_id int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.a_id, r.b_id) for r in tiling.overlapping(b, b, 4).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 3), (3, 1), (2, 3), (3, 2)}


def test_zones(spark):
    assert one(spark, geo.zone_of(F.lit("EPSG:32631"))) == "31N"
    assert one(spark, geo.zone_of(F.lit("EPSG:32760"))) == "60S"
    with pytest.raises(Exception, match="not a UTM system"):
        one(spark, geo.zone_of(F.lit("EPSG:4326")))
    assert one(spark, geo.is_north(F.lit("31S"))) is False
    assert one(spark, geo.is_north(F.lit("31S"), strict=True)) is True


@pytest.mark.parametrize("lat,lon,zone", [(52.1, 3.7, 31), (-33.9, 151.2, 56), (0.001, -177.5, 1), (71.0, 25.5, 35)])
def test_projection_round_trip(spark, lat, lon, zone):
    x, y = geo.to_utm(F.lit(lat), F.lit(lon), F.lit(zone))
    back = geo.to_latlon(F.col("x"), F.col("y"), F.lit(zone), F.lit(lat >= 0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", back[0].alias("lat"), back[1].alias("lon")).first()
    assert abs(r.lat - lat) < 1e-8 and abs(r.lon - lon) < 1e-8


def test_projection_of_a_known_point(spark):
    # the zone's meridian on the equator, and 3 degrees east of it (published values)
    r = spark.range(1).select(*geo.to_utm(F.lit(0.0), F.lit(3.0), F.lit(31))).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1]) < 1e-6
    assert abs(spark.range(1).select(*geo.to_utm(F.lit(0.0), F.lit(6.0), F.lit(31))).first()[0] - 833978.557) < 0.01


def test_corner_affine_is_exact_for_a_parallelogram(spark):
    corner = lambda c, r: (F.lit(2.0 + 0.5 * c - 0.25 * r), F.lit(7.0 + 0.125 * c + r))
    corners = [corner(0, 4), corner(8, 4), corner(8, 0), corner(0, 0)]
    lon, lat = geo.corner_affine(corners, F.lit(3.0), F.lit(1.0), F.lit(8.0), F.lit(4.0))
    assert one(spark, lon) == 8.375 and one(spark, lat) == 3.25


@pytest.mark.parametrize("seconds,text", [(0, "00:00"), (59, "00:59"), (60, "01:00"), (61, "01:01"), (120, "02:00"), (121, "02:01"), (3599, "59:59"), (3600, "60:00")])
def test_to_mmss(spark, seconds, text):
    assert one(spark, strings.to_mmss(F.lit(seconds))) == text


def test_parse_params(spark):
    got = one(spark, strings.parse_params(F.lit("a=true:b=None:c=3:d=0.5:e=x")))
    assert {k: v["kind"] for k, v in got.items()} == {"a": "bool", "b": "none", "c": "int", "d": "float", "e": "str"}
    with pytest.raises(Exception, match="not k=v"):
        one(spark, strings.parse_params(F.lit("a=1:b")))


def test_names_and_points(spark):
    assert one(spark, strings.granule_of(F.lit("/a/b.c/EMIT_L1B_RAD_1.x.nc"))) == "EMIT_L1B_RAD_1.x"
    with pytest.raises(Exception, match="not a radiance file"):
        one(spark, strings.obs_path(F.lit("/a/b.nc")))
    assert one(spark, strings.point_wkt(F.lit(None).cast("double"), F.lit(1.0))) == ""
    assert one(spark, strings.point_wkt(F.lit(1.5), F.lit(2.0))) == "POINT (1.5000000000000000 2.0000000000000000)"


def test_weights(spark):
    assert one(spark, weights.l2_border(F.lit(4), F.lit(4), 8)) == 1.0
    assert one(spark, weights.l2_border(F.lit(0), F.lit(0), 8)) == 0.001
    assert [round(one(spark, weights.l1_border(F.lit(k), F.lit(4), 8)), 3) for k in range(4)] == [0.333, 0.667, 1.0, 1.0]
    with pytest.raises(ValueError):
        weights.l1_border(F.lit(0), F.lit(0), 7)
    assert one(spark, weights.hann(F.lit(0), 1)) == 1.0 and abs(one(spark, weights.hann(F.lit(2), 5)) - 1) < 1e-12
    assert one(spark, weights.tukey(F.lit(50), 101)) == 1.0 and abs(one(spark, weights.tukey(F.lit(0), 101))) < 1e-12
    assert abs(one(spark, weights.tukey(F.lit(5), 101)) - 0.5) < 1e-12


def test_orthorectified_marks_both_kinds_of_nothing(spark):
    glt = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 0, 1, 0, 1), (1, 1, 0, 1, 0), (1, 1, 1, 9, 9), (1, 2, 2, None, 1)], "granule_id int, gy int, gx int, glt_x int, glt_y int")
    raw = spark.createDataFrame([(1, 0, 0, 5.0, 2)], "granule_id int, downtrack int, crosstrack int, v double, c int")
    got = {(r.gy, r.gx): (r.v, r.c) for r in orthorectified(glt, raw, ["v", "c"], {"c": -9999}).collect()}
    assert got == {(0, 0): (5.0, 2), (0, 1): (None, -9999), (1, 0): (None, -9999), (1, 1): (None, -9999), (2, 2): (None, -9999)}


@pytest.mark.parametrize("bounded", [False, True])
def test_heads_and_components(spark, bounded):
    px = block(spark, 4, 6, 4, 6, p=0.9).unionByName(block(spark, 0, 1, 0, 1, p=0.95)).unionByName(block(spark, 9, 10, 9, 10, p=0.1))
    head = components.head_points(px, ["granule_id"], "p", 0.4, bounded).first()
    assert (head.head_x, head.head_y) == (4.5, 4.5)
    labels = components.labelled(px, ["granule_id"], bounded)
    assert labels.select("label").distinct().count() == 3
    assert components.without_small(labels, ["granule_id"], 2).count() == 4
    at = spark.createDataFrame([(1, 0.2, 0.4)], "granule_id int, head_x double, head_y double")
    assert components.without_small(labels, ["granule_id"], 2, at).count() == 5
    assert components.head_points(px, ["granule_id"], "p", 0.99, bounded).count() == 0


def test_kernels_take_many_whole_keys_at_once(spark):
    """Keys that span batches stay whole, a null is a key, and one call has several keys."""
    from plumeloom.operators import geometry
    from plumeloom.plans.keyed import by_whole_keys

    rows = [(None if k == 3 else f"s{k % 5}", k, y, x) for k in range(60) for y in range(1 + k % 4) for x in range(k % 7, 9) if (x + y + k) % 4]
    px = spark.createDataFrame(rows, "granule_id string, k int, y long, x long").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        keys = ["granule_id", "k"]
        sizes = by_whole_keys(px, keys, lambda t, at: t.take(at).select(keys).append_column("n", [np.diff(at, append=t.num_rows)]).append_column("together", [np.full(len(at), len(at))]), "granule_id string, k int, n long, together long").collect()
        want = {}
        for g, k, *_ in rows:
            want[g, k] = want.get((g, k), 0) + 1
        assert {(r.granule_id, r.k): r.n for r in sizes} == want and len(sizes) == len(want) and max(r.together for r in sizes) > 1
        plain = px.filter("granule_id IS NOT NULL")
        got, rounds = (sorted(map(tuple, components.labelled(plain, keys, bounded).select(*keys, "y", "x", "label").collect())) for bounded in (True, False))
        assert got == rounds
        areas = geometry.area_and_bounds(plain, keys).count()
        assert geometry.mask_wkt(plain, keys).filter("geometry LIKE '%POLYGON%'").count() == areas == len(want) - 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_center_of_mass(spark):
    assert components.center_of_mass(block(spark, 4, 7, 4, 7, v=2), ["granule_id"], "v").first()[1:] == (5.0, 5.0)
    assert components.center_of_mass(block(spark, 4, 6, 4, 6, v=0), ["granule_id"], "v").count() == 0


def test_head_squares(spark):
    px = block(spark, 0, 10, 0, 10, v=1)
    at = spark.createDataFrame([(1, 5.0, 0.0)], "granule_id int, head_x double, head_y double")
    assert masks.head_squares(px, at, 3, ["granule_id"]).count() == 6  # one row is outside
    assert masks.head_squares(px, at, 0, ["granule_id"]).count() == 0
    with pytest.raises(ValueError):
        masks.head_squares(px, at, 4, ["granule_id"])


def test_exclusion(spark):
    px = block(spark, 30, 45, 30, 45).withColumnsRenamed({"y": "gy", "x": "gx"})
    at = spark.createDataFrame([(1, 1, 50.0, 50.0)], "plume_id int, granule_id int, head_x double, head_y double")
    got = masks.excluded(px, at, 10)
    assert got.count() == 25 and got.agg(F.max("y"), F.max("x")).first() == (4, 4)


def points(spark, rows):
    return spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "granule_id int, id long, x double, y double")


def patches(spark, values):
    rows = [(1, k, gy, gx, float(v[gy % 3][gx % 3])) for k, (y, x, v) in enumerate(values) for gy in range(y, y + 3) for gx in range(x, x + 3)]
    return spark.createDataFrame(rows, "granule_id int, id long, gy int, gx int, value double")


def labels_of(df):
    return [r.cluster for r in df.orderBy("id").collect()]


def test_correlation_clusters(spark):
    a = [[1, 2, 3], [4, 5, 6], [7, 8, 10]]
    b = [[-v for v in r] for r in a]
    p = points(spark, [(1, 1), (1, 1), (1, 1), (1, 1)])
    px = patches(spark, [(0, 0, a), (0, 0, a), (0, 0, b), (0, 0, b)])
    assert labels_of(clusters.clustered(p, "DBSCANCorr", px, eps_dist=2, eps_corr=0.5, min_samples=2)) == [0, 0, 1, 1]
    assert labels_of(clusters.clustered(p, "DBSCANCorr", px, eps_dist=2, eps_corr=0.5, min_samples=3)) == [-1] * 4
    assert labels_of(clusters.clustered(p, "DBSCANCorr", px, eps_dist=2, eps_corr=-2.0, min_samples=2)) == [0] * 4
    flat = patches(spark, [(0, 0, [[1] * 3] * 3)] * 4)
    assert labels_of(clusters.clustered(p, "DBSCANCorr", flat, eps_dist=2, eps_corr=0.0, min_samples=1)) == [-1] * 4


@pytest.mark.parametrize("cells", [1024, 5])
def test_correlation_equals_numpy(spark, monkeypatch, cells):
    """Patches of many shapes, with holes, that overlap wholly, in part or not at all; and in bands."""
    monkeypatch.setattr(clusters, "CELLS", cells)
    rng = np.random.default_rng(4)
    maps, rows = {}, []
    for i in range(14):
        y0, x0, h, w = rng.integers(0, 9), rng.integers(-4, 9), rng.integers(1, 8), rng.integers(1, 8)
        of = {(y, x): int(rng.integers(0, 20)) for y in range(y0, y0 + h) for x in range(x0, x0 + w) if rng.random() < 0.8}
        of = dict.fromkeys(of, 3) if i == 5 else of
        maps[i] = of
        rows += [(1, i, int(y), int(x), float(v)) for (y, x), v in of.items()]
    px = spark.createDataFrame(rows, "granule_id long, id long, gy long, gx long, value double")
    pairs = spark.range(15).select(F.lit(1).cast("long").alias("granule_id"), F.col("id").alias("a")).join(spark.range(15).select(F.col("id").alias("b")))
    got = {(r.a, r.b): r.corr for r in clusters.correlated(pairs, px).collect()}
    assert len(got) == 225
    for (a, b), corr in got.items():
        both = sorted(maps.get(a, {}).keys() & maps.get(b, {}).keys())
        u, v = (np.array([maps[k][p] for p in both], float) for k in (a, b)) if both else (np.zeros(1), np.zeros(1))
        want = np.corrcoef(u, v)[0, 1] if u.std() > 0 and v.std() > 0 else 0.0
        assert abs(corr - want) < 1e-9, (a, b)


def brute_dbscan(at, eps, least):
    n = len(at)
    near = [[j for j in range(n) if (at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2 <= eps * eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label, count = [None] * n, 0
    for i in range(n):
        if core[i] and label[i] is None:
            todo, label[i] = [i], count
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = count
                        todo.append(j)
            count += 1
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)]


@pytest.mark.parametrize("eps,least,spread,grid", [(1.0, 3, 6, False), (1.0, 5, 4, False), (2.0, 4, 12, True), (1.0, 1, 9, False), (0.7, 12, 3, False), (3.0, 2, 40, True)])
def test_dense_clusters_equal_a_plain_version(spark, eps, least, spread, grid):
    """Full cells, thin cells, equal points and points at a distance of exactly eps."""
    rng = np.random.default_rng(int(10 * eps) + least)
    at = rng.integers(0, spread, (160, 2)).astype(float) if grid else np.round(np.vstack([rng.uniform(0, spread, (110, 2)), rng.normal(spread / 2, 0.3, (30, 2)), np.full((20, 2), 1.25)]), 3)
    p = points(spark, at.tolist())
    assert labels_of(clusters.clustered(p, "DBSCAN", eps=eps, min_samples=least)) == brute_dbscan(at.tolist(), eps, least)


def test_tables_of_any_length_are_not_broadcast(spark):
    """A plan guesses exploded rows and files of few values far too small; no join of points may pass the driver."""
    at = points(spark, [(k % 40, k // 40) for k in range(400)])
    near = clusters.neighbours(at, 1)
    pixels = at.select("granule_id", "id", F.col("y").cast("long").alias("gy"), F.col("x").cast("long").alias("gx"), F.lit(1.0).alias("value"))
    found = [near, clusters.correlated(near, pixels), clusters.dbscan(at, 1, 4), clusters.density_clusters(at, near, 4), clusters.clustered(at, "DBSCAN", eps=1, min_samples=4)]
    found.append(components.labelled(at.select("granule_id", "y", "x"), ["granule_id"]))
    for df in found:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert found[2].filter("cluster = 0").count() == 400


def test_ten_thousand_equal_points_make_no_pairs(spark):
    p = spark.range(10_000).select(F.lit(1).alias("granule_id"), "id", F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    far = p.limit(1).select("granule_id", F.lit(20_000).cast("long").alias("id"), F.lit(90.0).alias("x"), F.lit(4.0).alias("y"))
    beside = far.withColumns({"id": F.lit(20_001).cast("long"), "x": F.lit(4.0)})
    got = clusters.clustered(p.unionByName(far).unionByName(beside), "DBSCAN", eps=1.0, min_samples=5)
    assert {(r.cluster, r.n) for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {(0, 10_001), (-1, 1)}


def test_distance_clusters(spark):
    p = points(spark, [(0, 0), (1, 0), (50, 50), (51, 50), (99, 0)])
    assert labels_of(clusters.clustered(p, "DBSCAN", eps=2, min_samples=2)) == [0, 0, 1, 1, -1]
    headless = p.unionByName(spark.createDataFrame([(1, 9, None, None)], p.schema))
    assert labels_of(clusters.clustered(headless, "DBSCAN", eps=2, min_samples=2))[-1] is None
    with pytest.raises(ValueError):
        clusters.clustered(p, "other")
    with pytest.raises(TypeError):
        clusters.clustered(p, "DBSCAN", eps=2, min_samples=2, patch_size=3)


def test_settings_are_checked():
    assert Settings().most_in_cluster == 16
    for bad in ({"clustering": "x"}, {"gas": "x"}, {"vetting_patch": 3}, {"clustering_kw": {}}, {"clustering": "DBSCAN", "clustering_kw": {"patch_size": 3}}, {"clustering_kw": {"patch_size": 4}}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_cap_takes_the_largest(spark):
    c = spark.createDataFrame([(1, 0, k, 0, n) for k, n in enumerate((2, 8, 4, 8))] + [(1, -1, 9, 0, 99), (1, None, 9, 0, 99)], "granule_id int, cluster int, chunk_id int, slot_id int, n_pixels int")
    got = merging.capped(merging.grouped(c), 2).orderBy("place").collect()
    assert [(r.chunk_id, r.cluster_size) for r in got] == [(1, 2), (3, 2)]


def test_merge_leaves_out_invalid_pixels(spark):
    px = block(spark, 0, 1, 0, 2, c=10.0).withColumnsRenamed({"y": "gy", "x": "gx"}).withColumn("valid", F.col("gx") == 0)
    got = {r.gx: (r.c, r.n_support) for r in merging.merged(px, ["granule_id"], ["c"], F.lit(1.0), 0.01).collect()}
    assert math.isclose(got[0][0], 10 / 1.01) and got[0][1] == 1 and got[1] == (0.0, 0)


def test_bands(spark):
    b = bands.catalogue(spark)
    n = lambda f, gas: b.filter(f(F.col("centre"), gas)).count()
    assert b.count() == 285
    assert (n(bands.outside_gas, "methane"), n(bands.outside_gas, "co2")) == (232, 227)
    assert (n(bands.strongly_absorbing, "methane"), n(bands.strongly_absorbing, "co2")) == (46, 27)
    with pytest.raises(ValueError):
        bands.outside_gas(F.lit(1.0), "steam")


def test_vetting_of_a_known_plume(spark):
    """Plume radiance 1 on a background of 2, enhancement 10: ratio 0.5, path 2, target 10."""
    n, inside = 12, (F.col("y").between(3, 6)) & (F.col("x").between(3, 6))
    patch = block(spark, 0, 10, 0, 10, plume_id=1, sun_zenith=0.0, sensor_zenith=0.0).drop("granule_id")
    patch = patch.withColumns({"plume": inside, "background": ~inside, "enhancement": F.when(inside, 10.0).otherwise(0.0)})
    patch = patch.withColumn("radiance", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(inside, 1.0).otherwise(2.0)))
    samples = [(k, 2100.0 + 30 * k, [1.0] * 10, [1.0] * 10, [0.8] * 10) for k in range(n)]
    got = vetting.vetted(patch, samples, 100.0, "methane", [0, 1, 2]).first()
    assert got.observed_conc == 10.0 and all(abs(v - 0.5) < 1e-6 for v in got.observed_transmittance_sel)
    assert all(abs(v - 0.5) < 1e-6 for v in got.modeled_transmittance)
    assert vetting.path_factor(patch).first()["path"] == 2.0
    assert vetting.vetted(patch.withColumn("background", F.lit(False)), samples, 100.0, "methane", [0]).count() == 0
    assert vetting.vetted(patch.withColumn("plume", F.lit(False)), samples, 100.0, "methane", [0]).count() == 0


def test_vetting_takes_spectra_from_the_scene(spark):
    """Two plumes on one scene: a patch without spectra is scored as one that holds them."""
    inside = F.col("y").between(3, 6) & F.col("x").between(3, 6)
    patch = block(spark, 0, 10, 0, 10).crossJoin(spark.createDataFrame([(1, 0), (2, 4)], "plume_id int, left int"))
    patch = patch.withColumns({"granule_id": F.lit(1), "gy": F.col("y"), "gx": F.col("x") + F.col("left"), "sun_zenith": F.lit(30.0), "sensor_zenith": F.lit(5.0), "plume": inside, "background": ~inside, "enhancement": F.when(inside, F.col("y") * 10.0 + F.col("x")).otherwise(0.0)}).drop("left")
    spectrum = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: 1.0 + (F.col("gy") * 7 + F.col("gx") * 3 + k * 5) % 11)
    patch = patch.withColumn("radiance", F.when((F.col("gy") == 5) & (F.col("gx") == 8), F.array().cast("array<double>")).otherwise(spectrum))
    samples = [(k, 2100.0 + 30 * k, [1.0, 0.5], [0.9, 0.95], [0.8, 0.7]) for k in range(12)]
    scene = patch.select("granule_id", "gy", "gx", "radiance").distinct()
    light = patch.withColumn("usable", masks.usable(F.col("radiance"))).drop("radiance")
    want, got = (df.orderBy("plume_id").collect() for df in (vetting.vetted(patch, samples, 100.0, "methane", [0, 1, 2]), vetting.vetted(light, samples, 100.0, "methane", [0, 1, 2], scene=scene)))
    assert len(want) == 2 and [r.plume_id for r in got] == [r.plume_id for r in want]
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(u, v, rel_tol=1e-9) for u, v in zip(g.observed_transmittance_sel, w.observed_transmittance_sel, strict=True)) and g.observed_conc == w.observed_conc


def test_schemas(spark):
    assert len(schema.PREDICTED.fields) == 27 and len(schema.CANDIDATE.fields) == 8
    row = spark.createDataFrame([("g", 1, 0, 0, 0, 4, 4, "p", "p", None, None, None, None, 0.5, 7.0)], "granule_id string, chunk_id int, slot_id int, x0 int, y0 int, x1 int, y1 int, geometry string, geometry_px string, head_x double, head_y double, head_lon double, head_lat double, d_norm double, hrrr_u double")
    c = schema.candidates(row)
    assert c.columns == schema.CANDIDATE.names and c.first()["head_point"] == "" and c.first()["plume_bbox_px"] == [0, 0, 4, 4]
    p = schema.predicted(row).first()
    assert p["d_norm"] == 0.5 and p["hrrr_u_10m"] == 7.0 and p["ime_emission_rate"] is None
    assert schema.predicted(row, strict=True).first()["d_norm"] is None
    px = block(spark, 0, 2, 0, 2, p=0.9).withColumn("p", F.col("x") * 0.9)
    assert schema.raster(px, ["granule_id"], F.col("p") > 0.5, "mask").first()["mask"] == [False, True, False, True]


def test_raw_scene(spark, tmp_path):
    values = [float(k) for k in range(5)]
    rad = spark.createDataFrame([("g", 0, 0, values), ("g", 0, 1, [-9999.0, *values[1:]])], emit.RAW)
    obs = spark.createDataFrame([("g", 0, 0, values), ("g", 0, 1, values)], emit.RAW)
    glt = spark.createDataFrame([("g", 0, 0, 1, 1), ("g", 0, 1, 2, 1), ("g", 1, 0, 0, 0)], "granule_id string, gy int, gx int, glt_x int, glt_y int")
    got = {(r.gy, r.gx): r for r in emit.scene_from_raw(rad, obs, glt).collect()}
    assert got[0, 0].valid and got[0, 0].sensor_zenith == 2.0 and got[0, 0].sun_zenith == 4.0
    assert not got[0, 1].valid and got[0, 1].radiance[0] == 0.0 and got[0, 1].crosstrack == 1.0
    assert not got[1, 0].valid and got[1, 0].crosstrack == -9999.0


def test_gas_samples(tmp_path):
    import numpy as np

    of = {}
    for n in ("radiance_0", "radiance_1"):
        of |= {f"emit_l1b_{n}_none_spectral_responses": np.ones(3), f"emit_l1b_{n}_none_transmittances": np.ones(3), f"emit_l1b_{n}_methane_transmittances": np.full(3, 0.8), f"emit_l1b_{n}_methane_spectral_data_added_ppm-m": np.array([100.0])}
    np.savez(tmp_path / "s.npz", **of)
    rows, added = emit.gas_samples(str(tmp_path / "s.npz"), [(0, "radiance_0", 2100.0), (1, "radiance_1", 2110.0)], "methane")
    assert added == 100.0 and len(rows) == 2 and rows[1][4][0] == 0.8


def test_model_failures_name_the_path():
    with pytest.raises(ValueError, match="/nowhere"):
        emit.loaded_model(open, "/nowhere")


def test_stream_of_scenes(spark, tmp_path):
    from plumeloom.streaming import scenes

    spark.range(5).selectExpr("id AS granule_id", "0.9 AS p_plume", "timestamp '2024-01-01' AS ts").write.parquet(str(tmp_path / "in"))
    stream = scenes.arrivals(spark, str(tmp_path / "in"), "granule_id long, p_plume double, ts timestamp")
    q = scenes.process(stream, lambda df: df.filter("granule_id > 1"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert scenes.plume_counts(stream, 0.5).isStreaming
