"""Spectral vetting: does a plume's spectrum, over that of its background, look like the gas?

Pixels are rows (plume_id, y, x, ...) of a plume's patch; enhancement is in ppm m.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.kernels.assign import assigned
from plumeloom.kernels.fit import AT_ONCE, Transmittances, fitted_many
from plumeloom.operators.masks import dilated, usable
from plumeloom.plans.storage import shuffled, written
from plumeloom.sources.bands import BACKGROUND

TOP, QUANTILE, KEPT_SHARE = 30, 0.99, 0.5


def under_quantile(pixels: DataFrame, key: str = "plume_id", q: float = QUANTILE) -> DataFrame:
    """Plume pixels up to the quantile (linear interpolation) of their plume's enhancement."""
    limit = pixels.groupBy(key).agg(F.percentile("enhancement", q).alias("_limit"))
    return pixels.join(shuffled(limit), key).filter("enhancement <= _limit").drop("_limit")


def targets(pixels: DataFrame, key: str = "plume_id", top: int = TOP) -> DataFrame:
    """Pixels in the 3 x 3 squares around each plume's `top` strongest, within the plume; ties go
    to the lower right."""
    strongest = Window.partitionBy(key).orderBy(F.desc("enhancement"), F.desc("y"), F.desc("x"))
    seeds = pixels.withColumn("_k", F.row_number().over(strongest)).filter(F.col("_k") <= top).select(key, "y", "x")
    return dilated(seeds, pixels, [key])


def background_pool(patch: DataFrame, chosen: DataFrame, gas: str, key: str = "plume_id") -> DataFrame:
    """Background pixels (background is true) with little enhancement that are not targets."""
    low = patch.filter(F.col("background") & (F.col("enhancement") <= BACKGROUND[gas]))
    return low.join(shuffled(chosen), [key, "y", "x"], "left_anti")


def path_factor(patch: DataFrame, key: str = "plume_id") -> DataFrame:
    """Mean of sec(sun) + sec(sensor) zenith over the whole patch, padding (angle 0) included."""
    sec = lambda c: 1 / F.cos(F.radians(c))
    return patch.groupBy(key).agg(F.avg(sec("sun_zenith") + sec("sensor_zenith")).alias("path"))


def pair_costs(chosen: DataFrame, pool: DataFrame, key: str = "plume_id") -> DataFrame:
    """Euclidean distance of the spectra of each target and each background pixel of a plume."""
    a = chosen.select(key, F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("spectrum").alias("_a"))
    b = pool.select(key, F.col("y").alias("by"), F.col("x").alias("bx"), F.col("spectrum").alias("_b"))
    square = F.aggregate(F.zip_with("_a", "_b", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, x: s + x)
    return a.join(shuffled(b), key).select(key, "ty", "tx", "by", "bx", F.sqrt(square).alias("cost"))


def assignment(chosen: DataFrame, pool: DataFrame, key: str = "plume_id") -> DataFrame:
    """Each target's background pixel for the least total cost, one to one: one kernel call per
    plume (at most 9 TOP targets, and a patch of background)."""
    kind = chosen.schema[key].dataType.simpleString()
    spec = f"{key} {kind}, ty long, tx long, by long, bx long, cost double"

    def match(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=[key, "ty", "tx", "by", "bx", "cost"])
        a, b = a.sort_values(["y", "x"]), b.sort_values(["y", "x"])
        u, v = np.stack(a["spectrum"].to_numpy()).astype(float), np.stack(b["spectrum"].to_numpy()).astype(float)
        cost = np.sqrt(np.maximum(0, (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T))
        i, j = assigned(cost)
        return pd.DataFrame({key: k[0], "ty": a["y"].to_numpy()[i], "tx": a["x"].to_numpy()[i], "by": b["y"].to_numpy()[j], "bx": b["x"].to_numpy()[j], "cost": cost[i, j]})

    own = lambda df: df.select(key, "y", "x", "spectrum").toDF(key, "y", "x", "spectrum")  # noqa: E731  names of its own for each side
    return own(chosen).groupBy(key).cogroup(own(pool).groupBy(key)).applyInPandas(match, spec)


def best_matches(pairs: DataFrame, key: str = "plume_id", share: float = KEPT_SHARE) -> DataFrame:
    """The cheaper half of a plume's pairs, rounded down."""
    cheapest = Window.partitionBy(key).orderBy("cost", "ty", "tx", "by", "bx")
    return pairs.withColumns({"_k": F.row_number().over(cheapest), "_n": F.count("*").over(Window.partitionBy(key))}).filter(F.col("_k") <= F.floor(F.col("_n") * share)).drop("_k", "_n")


def mean_ratio(pairs: DataFrame, chosen: DataFrame, pool: DataFrame, key: str = "plume_id") -> DataFrame:
    """Per plume and band: mean target over mean background radiance (columns radiance)."""
    a = chosen.select(key, F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("radiance").alias("_a"))
    b = pool.select(key, F.col("y").alias("by"), F.col("x").alias("bx"), F.col("radiance").alias("_b"))
    both = pairs.join(shuffled(a), [key, "ty", "tx"]).join(shuffled(b), [key, "by", "bx"])
    bands = both.select(key, F.posexplode(F.arrays_zip("_a", "_b")).alias("band", "v"))
    return bands.groupBy(key, "band").agg((F.avg("v._a") / (F.avg("v._b") + F.lit(1e-20))).alias("ratio"))


def reference_ratio(samples: DataFrame, conc: float, path: float) -> DataFrame:
    """Per band: transmittance with conc more gas over that without, from samples (band, response,
    standard, gas transmittance)."""
    base = F.col("response") * F.pow("standard", F.lit(path))
    more = F.pow(F.col("gas") / (F.col("standard") + F.lit(1e-12)), F.lit(path * conc))
    return samples.groupBy("band").agg((F.sum(base * more) / (F.sum(base) + F.lit(1e-20))).alias("ratio"))


def spectral_scores(signals: DataFrame, key: str = "plume_id") -> DataFrame:
    """d_norm and d_cor from rows (key, band, observed, baseline, gas); null without spread."""
    e = signals.withColumn("e", F.col("observed") / (F.col("baseline") + F.lit(1e-20)))
    mean = e.groupBy(key).agg(F.avg("e").alias("_m"))
    sums = e.join(shuffled(mean), key).groupBy(key).agg(
        F.avg(F.abs(F.col("e") - F.col("gas"))).alias("_d"),
        F.avg(F.abs(F.col("e") - F.col("_m"))).alias("_s"),
        *[F.sum(F.expr(x)).alias(n) for n, x in (("se", "e"), ("sg", "gas"), ("see", "e * e"), ("sgg", "gas * gas"), ("seg", "e * gas"))],
        F.count("*").alias("n"),
    )
    ve, vg = F.expr("n * see - se * se"), F.expr("n * sgg - sg * sg")
    r = F.when((ve > 0) & (vg > 0), F.expr("n * seg - se * sg") / F.sqrt(ve * vg))
    return sums.select(key, F.try_divide("_d", F.when(F.col("_s") != 0, F.col("_s"))).alias("d_norm"), (1 - r * r).alias("d_cor"))


RESULT = "fitted_conc double, baseline_transmittance array<double>, observed_transmittance_sel array<double>, modeled_transmittance array<double>, wavelengths_sel array<double>"


def fits(observed: DataFrame, samples: list[tuple], added_ppm_m: float, key: str = "plume_id") -> DataFrame:
    """One fit per plume. observed: key, band, ratio, path; samples: (band, centre, response,
    standard, gas) with arrays, strong bands only (it is a fixed table and travels with the task).

    A plume's spectrum is gathered to one row, of as many numbers as there are bands."""
    one = F.struct(F.col("band").cast("long").alias("band"), F.col("ratio").cast("double").alias("ratio"))
    return fitted_spectra(observed.groupBy(key).agg(F.collect_list(one).alias("spectrum"), F.max("path").cast("double").alias("path")), samples, added_ppm_m, key)


def fitted_spectra(spectra: DataFrame, samples: list[tuple], added_ppm_m: float, key: str = "plume_id") -> DataFrame:
    """fits() of plumes that are rows: key, spectrum (an array of structs of band and ratio) and path. No shuffle; the
    spectra of a batch are fitted together."""
    table = sorted(samples)
    kind = spectra.schema[key].dataType.simpleString()
    numbers = np.array([s[0] for s in table], np.int64)
    centre = np.array([s[1] for s in table], float)
    x = (centre - centre.mean()) / (centre.std() or 1.0)
    gases = Transmittances(*([np.asarray(s[k], float) for s in table] for k in (2, 3)), [np.asarray(s[4], float) / (np.asarray(s[3], float) + 1e-12) for s in table])
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    step = max(1, AT_ONCE // max(1, len(table) * gases.width))

    def seen_of(spectrum: pa.Array) -> np.ndarray:
        """Ratios at the places of the table's bands; NaN where one has none."""
        band, ratio = (pc.struct_field(spectrum.flatten(), k).to_numpy(zero_copy_only=False) for k in (0, 1))
        row = pc.list_parent_indices(spectrum).to_numpy()
        at = np.minimum(np.searchsorted(numbers, band), len(numbers) - 1)
        known = numbers[at] == band
        seen = np.full((len(spectrum), len(numbers)), np.nan)
        seen[row[known], at[known]] = ratio[known]
        return seen

    def fit(seen: np.ndarray, path: np.ndarray) -> list[np.ndarray]:
        gas = gases.along(path)
        conc, coefficients = fitted_many(centre, seen, gas)
        base = coefficients @ np.vander(x, coefficients.shape[1], increasing=True).T
        return [conc * added_ppm_m, base, seen, base * gas(conc)[0], np.broadcast_to(centre, seen.shape)]

    def lists(values: np.ndarray, none: np.ndarray) -> pa.Array:
        offsets = np.append(0, np.cumsum(np.where(none, 0, values.shape[1]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[~none].ravel()), mask=pa.array(none))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                path = batch.column("path").to_numpy(zero_copy_only=False).astype(float)
                found = fit(seen_of(batch.column("spectrum")), path)
                none = np.isnan(found[0])
                columns = [pa.array(found[0], mask=none), *(lists(v, none) for v in found[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *names])

    return spectra.select(key, "spectrum", "path").mapInArrow(every, f"{key} {kind}, {RESULT}")


def vetted(patch: DataFrame, samples: list[tuple], added_ppm_m: float, gas: str, match_bands: list[int], key: str = "plume_id", scene: DataFrame | None = None) -> DataFrame:
    """Scores per plume from its patch: key, y, x, radiance (array), enhancement, plume, background,
    sun_zenith, sensor_zenith. Plumes without targets, background or a kept pair have no row.

    match_bands: the bands outside the gas, on which targets and background are matched.
    scene: has the spectra (granule_id, gy, gx, radiance), if the patch has granule_id, gy, gx and usable in place of radiance.
    Targets and background are found without spectra, which are joined to these pixels alone.
    """
    place = [key, "y", "x"] if scene is None else ["granule_id", "gy", "gx"]
    spectra = (patch if scene is None else scene).select(*place, "radiance")
    seen = patch.filter(usable(F.col("radiance")) if scene is None else "usable").select(*dict.fromkeys([key, "y", "x", *place]), "enhancement", "plume", "background")
    chosen = written(targets(under_quantile(seen.filter("plume"), key), key).drop("plume", "background"), "targets")
    pool = background_pool(seen, chosen.select(key, "y", "x"), gas, key).drop("plume", "background")
    of_target = chosen.withColumn("target", F.lit(True)).unionByName(pool.withColumn("target", F.lit(False)))
    both = written(of_target.join(shuffled(spectra), place).select(key, "y", "x", "target", "radiance"), "vetting-spectra")
    both = both.withColumn("spectrum", F.transform(F.array(*map(F.lit, match_bands)), lambda k: F.get("radiance", k).cast("double")))
    on_target, pool = both.filter("target"), both.filter("NOT target")
    pairs = written(best_matches(assignment(on_target, pool, key), key), "matches")
    observed = mean_ratio(pairs, on_target, pool, key).join(shuffled(path_factor(patch, key)), key)
    mean = chosen.groupBy(key).agg(F.avg("enhancement").alias("observed_conc"))
    fit = written(fits(observed, samples, added_ppm_m, key), "fits")
    lines = fit.select(key, F.posexplode(F.arrays_zip("observed_transmittance_sel", "baseline_transmittance", "modeled_transmittance")).alias("band", "v"))
    base = F.col("v.baseline_transmittance")
    signals = lines.select(key, "band", F.col("v.observed_transmittance_sel").alias("observed"), base.alias("baseline"), (F.col("v.modeled_transmittance") / base).alias("gas"))
    scored = fit.join(shuffled(spectral_scores(signals, key)), key, "left")
    return scored.select(key, "d_norm", "d_cor", *[c for c in fit.columns if c != key]).join(shuffled(mean), key)
