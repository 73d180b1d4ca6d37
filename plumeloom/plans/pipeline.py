"""The whole run: tiles, candidates, clusters, plumes and vetting, as lazy DataFrames.

Tables. granules: granule_id, h, w, x0, y0 (upper left corner, metres), zone (31N). pixels:
granule_id, gy, gx, valid, radiance, sun_zenith, sensor_zenith. slots (the model's output):
granule_id, h_off, w_off, slot_id, y, x (in the tile), conc, p_plume, p_origin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.config import Settings
from plumeloom.functions import geo, weights
from plumeloom.functions.strings import plume_color
from plumeloom.operators import clusters, components, geometry, masks, merging, mosaic, tiling, vetting
from plumeloom.plans.inference import tiled_inference
from plumeloom.plans.metrics import Counters
from plumeloom.plans.storage import shuffled, written


def with_place(slots: DataFrame, pixels: DataFrame, counters: Counters | None = None) -> DataFrame:
    """Model output with global gy, gx, the scene's validity and chunk_id of surviving tiles."""
    placed = slots.withColumns({"gy": F.col("h_off") + F.col("y"), "gx": F.col("w_off") + F.col("x")})
    placed = placed.join(shuffled(pixels.select("granule_id", "gy", "gx", "valid")), ["granule_id", "gy", "gx"])
    tiles = tiling.surviving_tiles(placed).drop("n_valid")
    tiles = counters.on(tiles, "chunks") if counters else tiles
    return placed.join(shuffled(tiles), ["granule_id", "h_off", "w_off"])


def _georeferenced(df: DataFrame, granules: DataFrame, s: Settings) -> DataFrame:
    """Add a to f, the affine map from local pixel positions of each box to longitude, latitude."""
    df = df.join(F.broadcast(granules.select("granule_id", F.col("x0").alias("_gx0"), F.col("y0").alias("_gy0"), "zone")), "granule_id")  # one row a scene; else the boxes may be broadcast to it
    left, width, height = F.col("_gx0") + F.col("x0") * s.scale, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bottom = F.col("_gy0") - F.col("y1") * s.scale
    number, north = F.regexp_extract("zone", r"^(\d+)", 1).cast("int"), geo.is_north(F.col("zone"), s.strict)
    places = geo.box_corners(left, bottom, width, height, s.scale)
    df = df.withColumns({f"_{n}{k}": c for k, (x, y) in enumerate(places) for n, c in zip(("lat", "lon"), geo.to_latlon(x, y, number, north), strict=True)})
    corners = [(F.col(f"_lat{k}"), F.col(f"_lon{k}")) for k in range(4)]
    at = lambda c, r: geo.corner_affine(corners, c, r, width.cast("double"), height.cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    o, dx, dy = at(zero, zero), at(one, zero), at(zero, one)
    out = {"a": o[0], "b": dx[0] - o[0], "c": dy[0] - o[0], "d": o[1], "e": dx[1] - o[1], "f": dy[1] - o[1]}
    return df.withColumns(out).drop("_gx0", "_gy0", "zone", *[f"_{n}{k}" for k in range(4) for n in ("lat", "lon")])


AFFINE = ("a", "b", "c", "d", "e", "f")


def _with_heads(boxes: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with their local heads as global pixel positions and longitude, latitude."""
    met = boxes.join(shuffled(heads), keys, "left")
    x, y = F.col("head_x") + 0.5, F.col("head_y") + 0.5
    met = met.withColumns({"head_lon": F.col("a") + F.col("b") * x + F.col("c") * y, "head_lat": F.col("d") + F.col("e") * x + F.col("f") * y})
    return met.withColumns({"head_x": F.col("head_x") + F.col("x0"), "head_y": F.col("head_y") + F.col("y0")})


def _outlined(local: DataFrame, boxes: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """Boxes with geometry and geometry_px of the local mask pixels; boxes without pixels go."""
    px = local.join(shuffled(boxes.select(*keys, "x0", "y0", *AFFINE)), keys)
    forms = {"geometry_px": ("x0", 1, 0, "y0", 0, 1), "geometry": AFFINE}
    return boxes.join(shuffled(geometry.mask_wkts(px, keys, forms, s.simplify, s.keep_holes)), keys)


SLOT = ["granule_id", "chunk_id", "slot_id"]
GROUP = ["granule_id", "group_id"]


def extract_candidates(placed: DataFrame, granules: DataFrame, s: Settings, counters: Counters | None = None) -> DataFrame:
    """One row per slot with enough plume pixels: box (of its tile), geometries and head if any."""
    hits = masks.over_threshold(placed, "p_plume", s.plume_threshold)
    slots = masks.large_slots(hits, s.min_slot_pixels)
    tiles = placed.select("granule_id", "chunk_id", F.col("w_off").alias("x0"), F.col("h_off").alias("y0")).distinct()
    boxes = (counters.on(slots, "extracted") if counters else slots).join(shuffled(tiles), ["granule_id", "chunk_id"]).withColumns({"x1": F.col("x0") + s.tile_size, "y1": F.col("y0") + s.tile_size})
    boxes = written(_georeferenced(boxes, granules, s), "boxes")  # written as they are long expressions, which plans would hold twice
    inside = written(hits.join(shuffled(slots.select(*SLOT)), SLOT, "left_semi").select(*SLOT, "y", "x", "p_origin"), "inside")
    heads = components.head_points(inside.select(*SLOT, "y", "x", "p_origin"), SLOT, "p_origin", s.origin_threshold, bounded=True)
    out = _outlined(inside.select(*SLOT, "y", "x"), boxes, SLOT, s)
    return _with_heads(out, heads, SLOT)


def with_rasters(candidates: DataFrame, placed: DataFrame, s: Settings) -> DataFrame:
    """Candidates with the whole tile of their slot, in row order: concentration and the three masks."""
    px = placed.join(shuffled(candidates.select(*SLOT)), SLOT, "left_semi")
    one = F.struct("y", "x", F.col("conc").cast("float").alias("c"), (F.col("p_plume") > s.plume_threshold).alias("b"), (F.col("p_origin") > s.origin_threshold).alias("o"), "valid")
    tiles = px.groupBy(*SLOT).agg(F.sort_array(F.collect_list(one)).alias("t"))  # one tile of one slot
    names = {"concentration": "c", "binary_mask": "b", "origin_mask": "o", "mask": "valid"}
    return candidates.join(shuffled(tiles.select(*SLOT, *[F.col(f"t.{c}").alias(n) for n, c in names.items()])), SLOT)


def cluster_plumes(candidates: DataFrame, placed: DataFrame, s: Settings, counters: Counters | None = None) -> DataFrame:
    """Candidates with cluster and id; ids differ over all scenes and rise with tile and slot."""
    ordered = candidates.repartition("granule_id").sortWithinPartitions("granule_id", "chunk_id", "slot_id")
    ids = written(ordered.withColumn("id", F.monotonically_increasing_id()), "candidates")
    points = ids.select("granule_id", "id", F.col("head_x").alias("x"), F.col("head_y").alias("y"))
    kw = dict(s.clustering_kw)
    patch = kw.pop("patch_size", None)
    patches = None
    if patch:
        heads = ids.filter("head_x IS NOT NULL").select(*SLOT, "id", "head_x", "head_y")
        px = placed.select(*SLOT, F.col("gy").alias("y"), F.col("gx").alias("x"), F.col("conc").alias("value"), "valid").filter("valid")
        patches = masks.head_squares(px, heads, patch, SLOT).join(shuffled(heads.select(*SLOT, "id")), SLOT)
        patches = patches.select("granule_id", "id", F.col("y").alias("gy"), F.col("x").alias("gx"), "value")
    return ids.join(shuffled(clusters.clustered(points, s.clustering, patches, counters, **kw)), ["granule_id", "id"])


@dataclass
class Plumes:
    """plumes: one row per plume. pixels: their cropped rasters (keys, gy, gx, conc, p_plume,
    p_origin, hit)."""

    plumes: DataFrame
    pixels: DataFrame


def dedupe(clustered: DataFrame, placed: DataFrame, granules: DataFrame, scene: DataFrame, s: Settings, weight: Column | None = None) -> Plumes:
    """Merge each cluster's candidates into one plume, clean its mask and outline it."""
    size = s.tile_size
    window = {"hanning": weights.hann, "tukey": weights.tukey}[s.window]
    weight = weight if weight is not None else weights.outer(window, F.col("y"), F.col("x"), size)
    kept = merging.capped(merging.grouped(clustered), s.most_in_cluster).withColumnRenamed("cluster", "group_id")
    members = placed.join(shuffled(kept.select(*SLOT, "group_id")), SLOT)
    values = ["conc", "p_plume", "p_origin"]
    merged = written(merging.merged(members, GROUP, values, weight, s.regularizer), "merged")
    box = merging.bounds(kept, GROUP).join(shuffled(kept.groupBy(*GROUP).agg(F.max("cluster_size").alias("cluster_size"))), GROUP)
    local = merged.join(shuffled(box.select(*GROUP, F.col("x0").alias("bx"), F.col("y0").alias("by"))), GROUP)
    local = local.join(shuffled(scene.select("granule_id", "gy", "gx", "valid")), ["granule_id", "gy", "gx"])
    local = local.select(*GROUP, (F.col("gy") - F.col("by")).alias("y"), (F.col("gx") - F.col("bx")).alias("x"), *values, "valid", "bx", "by")
    local = written(local, "local")  # read for labels, heads, sizes and bounds
    hit = local.filter((F.col("p_plume") > s.plume_threshold) & F.col("valid"))
    labels = components.labelled(hit.select(*GROUP, "y", "x"), GROUP, bounded=True)
    before = components.head_points(hit.select(*GROUP, "y", "x", "p_origin"), GROUP, "p_origin", s.origin_threshold, bounded=True) if s.keep_origin_component else None
    clean = written(components.without_small(labels, GROUP, s.cc_min_size, before).select(*GROUP, "y", "x", F.lit(True).alias("hit")), "clean")
    raster = local.join(shuffled(clean), [*GROUP, "y", "x"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    raster = written(components.cropped(raster, GROUP, s.border), "cropped")
    raster = raster.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")})
    boxes = raster.groupBy(*GROUP).agg(*[(F.max(c) + F.max(b)).alias(c) for c, b in (("x0", "bx"), ("y0", "by"), ("x1", "bx"), ("y1", "by"))])
    boxes = written(_georeferenced(boxes.join(shuffled(box.select(*GROUP, "cluster_size")), GROUP), granules, s), "boxes")
    heads = components.head_points(raster.filter("hit").select(*GROUP, "y", "x", "p_origin"), GROUP, "p_origin", s.origin_threshold, bounded=True)
    plumes = _with_heads(_outlined(raster.filter("hit").select(*GROUP, "y", "x"), boxes, GROUP, s), heads, GROUP).filter("head_x IS NOT NULL")
    plumes = plumes.withColumn("color", plume_color(*[F.col(k).cast("string") for k in GROUP]))
    px = raster.select(*GROUP, (F.col("y") + F.col("y0") + F.col("by")).alias("gy"), (F.col("x") + F.col("x0") + F.col("bx")).alias("gx"), *values, "hit")
    return Plumes(written(plumes, "plumes"), px)


def stacked(found: Plumes) -> DataFrame:
    """Each plume's raster: keys, x0, y0, width, height and raster, in row order, of (conc, p_plume, p_origin)."""
    layers = F.struct(*[F.col(c).cast("float").alias(c) for c in ("conc", "p_plume", "p_origin")])
    box = [F.min("gx").alias("x0"), F.min("gy").alias("y0"), (F.max("gx") - F.min("gx") + 1).alias("width"), (F.max("gy") - F.min("gy") + 1).alias("height")]
    rows = found.pixels.groupBy(*GROUP).agg(*box, F.sort_array(F.collect_list(F.struct("gy", "gx", layers.alias("v")))).alias("t"))
    return rows.select(*GROUP, "x0", "y0", "width", "height", F.col("t.v").alias("raster"))


def vetting_patches(found: Plumes, candidates_px: DataFrame, enhancement: DataFrame, scene: DataFrame, s: Settings) -> DataFrame:
    """Each plume's vetting patch: plume_id, y, x, granule_id, gy, gx, usable, enhancement, plume, valid, background, angles.

    Places outside the scene are rows too: padding has angle 0 and is not usable. Patches overlap, so spectra stay with the scene."""
    reach, at, own = s.vetting_patch // 2, ["granule_id", "gy", "gx"], ["plume_id", "y", "x"]
    heads = found.plumes.select("granule_id", F.concat_ws(":", *GROUP).alias("plume_id"), "group_id", "head_x", "head_y")
    exclusion = masks.excluded(candidates_px, heads, reach)
    boxes = heads.withColumns({"x0": F.col("head_x").cast("long") - reach, "y0": F.col("head_y").cast("long") - reach})
    grid = boxes.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * reach - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * reach - 1))))
    grid = grid.select(*GROUP, *own, (F.col("y0") + F.col("y")).alias("gy"), (F.col("x0") + F.col("x")).alias("gx"))
    seen = scene.select(*at, "valid", masks.usable(F.col("radiance")).alias("usable"), "sun_zenith", "sensor_zenith")
    rows = grid.join(shuffled(seen), at, "left").join(shuffled(enhancement.select(*at, "enhancement")), at, "left")
    rows = rows.join(shuffled(found.pixels.filter("hit").select(*GROUP, "gy", "gx", F.lit(True).alias("plume"))), [*GROUP, "gy", "gx"], "left")
    rows = rows.join(shuffled(exclusion.withColumn("_taken", F.lit(True))), own, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    true = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(*own, *at, *[true(c).alias(c) for c in ("usable", "plume", "valid")], (true("valid") & F.col("_taken").isNull()).alias("background"), zero("enhancement"), zero("sun_zenith"), zero("sensor_zenith"))


def enhancement(placed: DataFrame, s: Settings) -> DataFrame:
    """The scene's enhancement image from all tiles."""
    return mosaic.mosaic(placed, "conc", weights.l2_border(F.col("gy") - F.col("h_off"), F.col("gx") - F.col("w_off"), s.tile_size))


def run(slots: DataFrame, pixels: DataFrame, granules: DataFrame, s: Settings, samples: list[tuple] | None = None, match_bands: list[int] | None = None, added_ppm_m: float = 1.0, counters: Counters | None = None, rasters: bool = False, weight: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates, plumes (with vetting scores where samples are given) and the enhancement image.

    Scores never filter plumes. counters: told what they want to know of plans.metrics.EVERYTHING.
    rasters: candidates and plumes come with theirs. weight: of tiles that overlap, the settings' window if none.
    """
    placed = written(with_place(slots, pixels, counters), "placed")
    found = extract_candidates(placed, granules, s, counters)
    found = counters.on(found, "candidates") if counters else found
    grouped = written(cluster_plumes(found, placed, s, counters), "clustered")
    plumes = dedupe(grouped, placed, granules, pixels, s, weight)
    image = enhancement(placed, s)
    out = counters.on(plumes.plumes, "plumes") if counters else plumes.plumes
    if samples:
        hits = masks.over_threshold(placed, "p_plume", s.plume_threshold).join(shuffled(grouped.select(*SLOT)), SLOT, "left_semi")
        patch = written(vetting_patches(plumes, hits.select("granule_id", "gy", "gx").distinct(), image, pixels, s), "patches")  # read for targets, background and path
        scores = vetting.vetted(patch, samples, added_ppm_m, s.gas, match_bands or [], scene=pixels)
        arrays = [f.name for f in scores.schema.fields if f.dataType.typeName() == "array"]
        scores = scores.withColumns({c: masks.whole_or_null(F.col(c)) for c in arrays})
        out = out.withColumn("plume_id", F.concat_ws(":", *GROUP)).join(shuffled(scores), "plume_id", "left").drop("plume_id")
    if rasters:
        box = F.array("x0", "y0", F.col("x0") + F.col("width"), F.col("y0") + F.col("height")).alias("raster_bbox_px")
        layers = {"concentration": "conc", "plume_probability": "p_plume", "origin_probability": "p_origin"}
        out = out.join(shuffled(stacked(plumes).select(*GROUP, box, *[F.col(f"raster.{c}").alias(n) for n, c in layers.items()])), GROUP)
    return with_rasters(grouped, placed, s) if rasters else grouped, out, image


def run_scene(pixels: DataFrame, granules: DataFrame, s: Settings, factory, model: str, samples: list[tuple] | None = None, match_bands: list[int] | None = None, added_ppm_m: float = 1.0, counters: Counters | None = None, rasters: bool = False, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """run() from orthorectified scenes: every tile goes through the model that factory(model) loads."""
    slots = written(tiled_inference(pixels, granules, factory, model, s.tile_size, s.stride, **kw), "slots")
    return run(slots, pixels, granules, s, samples, match_bands, added_ppm_m, counters, rasters)


def swept(placed: DataFrame, granules: DataFrame, settings: list[Settings]) -> DataFrame:
    """Candidates at several thresholds, tagged with plume_prob and origin_prob."""
    out = None
    for s in settings:
        one = extract_candidates(placed, granules, s).withColumns({"plume_prob": F.lit(s.plume_threshold), "origin_prob": F.lit(s.origin_threshold)})
        out = one if out is None else out.unionByName(one)
    return out
