"""python -m plumeloom: plumes of a scene's file, by a model, or of scenes in Parquet tables."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumeloom.config import Settings
from plumeloom.functions import weights
from plumeloom.operators.tiling import center_crop
from plumeloom.plans import outputs, pipeline
from plumeloom.plans.inference import tiled_inference
from plumeloom.plans.metrics import EVERYTHING, Counters
from plumeloom.plans.storage import written
from plumeloom.sources import bands, emit

WINDOWS = {"hanning": weights.hann, "tukey": weights.tukey}


def keywords(text: str) -> dict:
    """"k=v:k=v" with values that are bool, none, int, float or str, the first that fits."""
    out: dict = {}
    for item in text.split(":"):
        name, value = item.split("=")
        if value.lower() in ("true", "false", "none"):
            out[name] = {"true": True, "false": False, "none": None}[value.lower()]
            continue
        for kind in (int, float, str):
            try:
                out[name] = kind(value)
                break
            except ValueError:
                pass
    return out


def named(text: str):
    """"package.module:function" as the function."""
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", help="radiance file of a scene, with its observation file beside it")
    p.add_argument("--model", help="the model's path")
    p.add_argument("--factory", help="package.module:function that loads a model from its path")
    for name, what in (("slots", "the model's output, in place of a model"), ("pixels", "orthorectified pixels, in place of a file"), ("granules", "scenes of these pixels")):
        p.add_argument(f"--{name}", help=what)
    p.add_argument("--out", required=True, help="folder to write to")
    p.add_argument("--gas", default="methane", choices=sorted(bands.STRONG))
    p.add_argument("--sensor", default="emit_l1b", help="sensor whose spectra are taken from the gas statistics")
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--stride", type=int, default=64)
    p.add_argument("--scale", type=float, default=60.0)
    p.add_argument("--plume-threshold", type=float, default=0.5)
    p.add_argument("--origin-threshold", type=float, default=0.4)
    p.add_argument("--cc-min-size", type=int, default=10)
    p.add_argument("--clustering", default="DBSCANCorr")
    p.add_argument("--clustering-kw", type=keywords)
    p.add_argument("--eps-dist", type=float, help="of DBSCANCorr")
    p.add_argument("--eps-corr", type=float, help="of DBSCANCorr")
    p.add_argument("--min-samples", type=int, help="of DBSCANCorr")
    p.add_argument("--window", default="hanning", choices=sorted(WINDOWS), help="weights of merged tiles")
    p.add_argument("--most-in-cluster", type=int, help="candidates of a cluster that are merged; (tile size / stride) squared by default")
    p.add_argument("--drop-origin-component", action="store_true", help="let small components go even where they hold the origin")
    p.add_argument("--crop", type=int, help="only the middle of each scene, so many pixels wide and high")
    p.add_argument("--spectra", help="npz of gas statistics; without it plumes are not vetted")
    p.add_argument("--rasters", action="store_true", help="write the rasters of candidates and plumes too")
    p.add_argument("--count", action="store_true", help="print how many tiles, slots, candidates and plumes there were")
    p.add_argument("--strict", action="store_true", help="keep vetting scores out of the table")
    return p


def settings(a: argparse.Namespace) -> Settings:
    more = dict(a.clustering_kw) if a.clustering_kw else {}
    given = {k: v for k, v in (("eps_dist", a.eps_dist), ("eps_corr", a.eps_corr), ("min_samples", a.min_samples)) if v is not None}
    if given and not more:
        more = dict(Settings().clustering_kw)
    more |= given
    kw = {"clustering_kw": more} if more else {}
    return Settings(gas=a.gas, tile_size=a.tile_size, stride=a.stride, scale=a.scale, plume_threshold=a.plume_threshold, origin_threshold=a.origin_threshold, cc_min_size=a.cc_min_size, clustering=a.clustering, strict=a.strict, window=a.window, cluster_cap=a.most_in_cluster, keep_origin_component=not a.drop_origin_component, **kw)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if not a.input and not (a.pixels and a.granules):
        p.error("a scene is needed: --input, or --pixels and --granules")
    if not a.slots and not (a.model and a.factory):
        p.error("a model is needed: --model and --factory, or its output as --slots")
    s = settings(a)
    spark = spark or SparkSession.builder.appName("plumeloom").getOrCreate()
    given = None
    if a.input:
        pixels, granules, given = emit.read_scene(spark, a.input)
        pixels = written(pixels, "pixels")
    else:
        pixels, granules = spark.read.parquet(a.pixels), spark.read.parquet(a.granules)
    if a.crop:
        size = granules.select("granule_id", "h", "w", "x0", "y0", (F.col("scale") if "scale" in granules.columns else F.lit(a.scale)).alias("scale"))
        cut = center_crop(pixels.join(size, "granule_id"), a.crop)
        granules = granules.drop("h", "w", "x0", "y0").join(cut.select("granule_id", "h", "w", "x0", "y0").distinct(), "granule_id")
        pixels = cut.select(*pixels.columns)
    if a.slots:
        slots = spark.read.parquet(a.slots)
    else:
        slots = written(tiled_inference(pixels, granules, named(a.factory), a.model, s.tile_size, s.stride), "slots")
    samples, outside, added = None, None, 1.0
    if a.spectra:
        strong, outside = bands.chosen(a.gas, given)
        samples, added = emit.gas_samples(a.spectra, strong, a.gas, a.sensor)
    weight = weights.outer(WINDOWS[s.window], F.col("y"), F.col("x"), s.tile_size)
    counters = Counters(EVERYTHING) if a.count else None
    outputs.save(*pipeline.run(slots, pixels, granules, s, samples, outside, added, counters, a.rasters, weight), a.out, a.strict, a.rasters)
    for name, n in counters.values().items() if counters else ():
        print(f"{name}: {n}")


if __name__ == "__main__":
    main()
