"""Clustering of candidates by their heads, and by what the pixels around them look like.

A point is a row (granule_id, id: long, x, y). Neighbours are found by a grid of cells of the
search radius, so no pair of distant points is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.config import ALGORITHMS
from plumeloom.kernels.meanshift import mean_shift
from plumeloom.plans.graph import components
from plumeloom.plans.metrics import Counters
from plumeloom.plans.storage import shuffled, written


#: Cells of a pair that stand in one row, a multiple of a square's width at most.
CELLS = 1024
SUMS = ("n", "su", "sv", "suu", "svv", "suv")


def neighbours(points: DataFrame, eps: float) -> DataFrame:
    """granule_id, a, b for points at a distance of at most eps, both ways and with itself."""
    cell = {"cx": F.floor(F.col("x") / eps), "cy": F.floor(F.col("y") / eps)}
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = points.select("granule_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    a = a.withColumns({"cx": F.floor(F.col("ax") / eps), "cy": F.floor(F.col("ay") / eps)})
    a = a.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")})
    b = points.withColumns(cell).select("granule_id", "cx", "cy", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = a.join(shuffled(b), ["granule_id", "cx", "cy"])
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return met.filter(dx * dx + dy * dy <= eps * eps).select("granule_id", "a", "b")


def squares(patches: DataFrame) -> DataFrame:
    """granule_id, id, y0, x0, h, w, cells (rows of values, null where a patch has no pixel) and whether values vary:
    one row a head.

    patches: granule_id, id, gy, gx, value, a place at most once a patch. One shuffle by head.
    """
    of = Window.partitionBy("granule_id", "id")
    low = {"y0": F.min("gy").over(of), "x0": F.min("gx").over(of), "h": F.max("gy").over(of) - F.min("gy").over(of) + 1, "w": F.max("gx").over(of) - F.min("gx").over(of) + 1}
    head = ["granule_id", "id", *low]
    dense = lambda m, n: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: F.element_at(m, k))
    rows = patches.withColumns(low).groupBy(*head, (F.col("gy") - F.col("y0")).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("gx") - F.col("x0")).alias("c"), F.col("value").cast("double")))).alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
    rows = rows.select(*head, "r", dense(F.col("m"), "w").alias("row"), "least", "most")
    varied = F.coalesce(F.min("least") < F.max("most"), F.lit(False)).alias("varied")
    return rows.groupBy(*head).agg(F.map_from_entries(F.collect_list(F.struct("r", "row"))).alias("m"), varied).select(*head, "varied", dense(F.col("m"), "h").alias("cells"))


def correlated(pairs: DataFrame, patches: DataFrame, counters: Counters | None = None) -> DataFrame:
    """pairs with corr: Pearson's, over the pixels that both patches have valid. counters: told of
    the pairs that have none.

    patches: granule_id, id, gy, gx, value of valid pixels. 0 where there is no common pixel or no
    variance; sums are exact for whole numbers. Each unordered pair is computed once, from the two heads' squares in
    one row: no row stands for a pixel of a pair. Large squares go in bands of CELLS cells. pairs
    are symmetric; one whose patches do not meet has 0.
    """
    heads = squares(patches)
    side = lambda k: heads.select("granule_id", F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("y0", "x0", "h", "w", "cells")])
    both = pairs.filter("a < b").join(shuffled(side("a")), ["granule_id", "a"], "left").join(shuffled(side("b")), ["granule_id", "b"], "left")
    top, left = F.greatest("a_y0", "b_y0"), F.greatest("a_x0", "b_x0")
    tall, wide = F.expr("least(a_y0 + a_h, b_y0 + b_h)") - top, F.expr("least(a_x0 + a_w, b_x0 + b_w)") - left
    met = F.expr("a_h + b_h > 0") & (tall > 0) & (wide > 0)
    both = both.withColumns({"top": top, "left": left, "tall": F.when(met, tall).otherwise(0).cast("int"), "wide": F.when(met, wide).otherwise(0).cast("int")})
    step = f"greatest(1, {CELLS} div greatest(wide, 1))"
    both = both.withColumn("first", F.explode(F.expr(f"sequence(0, greatest(tall - 1, 0), {step})")))
    rows = lambda k: F.slice(f"{k}_cells", (F.col("top") - F.col(f"{k}_y0") + 1 + F.col("first")).cast("int"), F.expr(f"least(tall - first, {step})"))
    none = F.array_repeat(F.lit(None).cast("double"), F.col("wide"))
    cells = lambda k: F.when(F.col("tall") > 0, F.flatten(F.transform(rows(k), lambda row: F.coalesce(F.slice(row, (F.col("left") - F.col(f"{k}_x0") + 1).cast("int"), F.col("wide")), none)))).otherwise(F.array().cast("array<double>"))
    kind = pairs.schema["granule_id"].dataType.simpleString()
    names = ", ".join(f"{n} double" for n in SUMS)
    parts = both.select("granule_id", "a", "b", cells("a").alias("u"), cells("b").alias("v")).mapInArrow(_summed, f"granule_id {kind}, a long, b long, {names}")
    sums = parts.groupBy("granule_id", "a", "b").agg(*[F.sum(n).alias(n) for n in SUMS])
    vu, vv = F.expr("n * suu - su * su"), F.expr("n * svv - sv * sv")
    corr = F.when((vu > 0) & (vv > 0), F.expr("n * suv - su * sv") / (F.sqrt(vu) * F.sqrt(vv))).when(F.col("n") > 0, 0.0)
    out = sums.select("granule_id", "a", "b", corr.alias("corr"))
    out = counters.on(out, "no_valid_mask", F.col("corr").isNull()) if counters else out
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    out = out.select("granule_id", F.explode(ways).alias("e"), F.coalesce("corr", F.lit(0.0)).alias("corr")).select("granule_id", "e.a", "e.b", "corr")
    varied = heads.select("granule_id", F.col("id").alias("a"), F.lit(1.0).alias("corr")).filter(heads["varied"])
    alone = pairs.filter("a = b").join(shuffled(varied), ["granule_id", "a"], "left").select("granule_id", "a", "b", F.coalesce("corr", F.lit(0.0)).alias("corr"))
    return out.unionByName(alone)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows of two lists of cells, of which null ones do not count."""
    for batch in batches:
        u, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("u", "v"))
        lengths = pc.list_value_length(batch.column("u")).to_numpy(zero_copy_only=False).astype(np.int64)
        valid = ~(np.isnan(u) | np.isnan(v))
        u, v = np.where(valid, u, 0.0), np.where(valid, v, 0.0)
        some, starts, columns = lengths > 0, np.cumsum(lengths) - lengths, []
        for x in (valid.astype(float), u, v, u * u, v * v, u * v):
            columns.append(np.zeros(len(lengths)))
            if some.any():
                columns[-1][some] = np.add.reduceat(x, starts[some])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("granule_id", "a", "b")), *map(pa.array, columns)], names=["granule_id", "a", "b", *SUMS])


def density_clusters(points: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """granule_id, id, cluster from a symmetric neighbour relation; -1 is noise.

    A point is core if it has min_samples neighbours. Clusters are the components of core points,
    numbered from 0 by their least core id; another point takes the lowest cluster among its core
    neighbours. Point ids are unique over all scenes.
    """
    core = pairs.groupBy("granule_id", "a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select("granule_id", F.col("a").alias("id"))
    from_core = pairs.join(shuffled(core.select("granule_id", F.col("id").alias("a"))), ["granule_id", "a"])
    links = from_core.join(shuffled(core.select("granule_id", F.col("id").alias("b"))), ["granule_id", "b"])
    roots = components(links.select("a", "b"))
    rooted = core.join(shuffled(roots), core["id"] == roots["node"], "left").select("granule_id", "id", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("granule_id", "root").agg(F.min("id").alias("first"))
    number = first.withColumn("cluster", F.row_number().over(Window.partitionBy("granule_id").orderBy("first")).cast("long") - 1)
    of_core = rooted.join(shuffled(number), ["granule_id", "root"]).select("granule_id", "id", "cluster")
    border = from_core.select("granule_id", F.col("a").alias("id"), "b").join(shuffled(of_core), ["granule_id", "id"]).groupBy("granule_id", F.col("b").alias("id")).agg(F.min("cluster").alias("near"))
    out = points.select("granule_id", "id").join(shuffled(of_core), ["granule_id", "id"], "left").join(shuffled(border), ["granule_id", "id"], "left")
    return out.select("granule_id", "id", F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"))


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """density_clusters() of the points within eps of each other, without the pairs inside dense places.

    Equal points are one place with a weight. Cells are so small that their points are neighbours, so every place of a cell
    with min_samples points (a full cell) is core, and all are in one cluster, without a pair. Pairs are formed
    for places of other cells only: each of these holds few, so pairs grow with the places. Full
    cells are linked if their closest places are near, which the boxes of their quarters' quarters mostly tell; places are
    compared only between boxes that leave it open, and only where no other boxes of the two cells have decided.
    """
    side, at = eps / 1.4142136, ["granule_id", "cx", "cy"]
    places = points.groupBy("granule_id", "x", "y").agg(F.count("*").alias("n"), F.min("id").alias("node"))
    places = places.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    full = places.groupBy(*at).agg(F.sum("n").alias("n"), F.min("node").alias("cell")).filter(F.col("n") >= min_samples).select(*at, "cell")
    marked = written(places.join(shuffled(full), at, "left"), "marked-places")
    other = lambda df, *names: df.select(*at, *[F.col(c).alias(f"o_{c}") for c in names])

    def beside(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
        return df.withColumn("_s", step).withColumns({"cx": F.col("cx") + F.col("_s.dx"), "cy": F.col("cy") + F.col("_s.dy")}).drop("_s")

    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
    distance = F.pow(F.col("x") - F.col("o_x"), 2) + F.pow(F.col("y") - F.col("o_y"), 2)
    thin = beside(marked.filter("cell IS NULL").select(*at, "x", "y", F.col("node").alias("a")), steps)
    met = thin.join(shuffled(other(marked, "x", "y", "n", "node", "cell")), at).filter(distance <= eps * eps)
    pairs = written(met.select("granule_id", "a", F.col("o_n").alias("n"), F.col("o_node").alias("b"), F.col("o_cell").alias("cell")), "thin-pairs")
    core = written(pairs.groupBy("granule_id", "a").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("granule_id", "a"), "thin-cores")
    # where a pair leads: a full cell, a core of its own, or (null) neither
    led = pairs.join(shuffled(core.select(F.col("a").alias("b"), F.lit(True).alias("b_core"))), "b", "left")
    led = led.select("granule_id", "a", F.when(F.col("cell").isNotNull(), F.col("cell")).when(F.col("b_core"), F.col("b")).alias("to")).filter("to IS NOT NULL")
    links = led.join(shuffled(core), ["granule_id", "a"], "left_semi").select("a", F.col("to").alias("b"))

    forward = [s for s in steps if s > (0, 0)]
    boxed = marked.filter("cell IS NOT NULL").withColumns({"bx": F.floor(F.col("x") * 4 / side), "by": F.floor(F.col("y") * 4 / side)})
    bounds = {f"{f.__name__}_{c}": f(c) for c in "xy" for f in (F.min, F.max)}
    boxes = boxed.groupBy(*at, "cell", "bx", "by").agg(*[c.alias(k) for k, c in bounds.items()])
    names = ["cell", "bx", "by", *bounds]
    near = beside(boxes, forward).join(shuffled(other(boxes, *names)), at)
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"min_{c}") - F.col(f"o_max_{c}"), F.col(f"o_min_{c}") - F.col(f"max_{c}"))
    span = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"o_min_{c}"), F.col(f"o_max_{c}") - F.col(f"min_{c}"))
    near = near.filter(gap("x") * gap("x") + gap("y") * gap("y") <= eps * eps)
    near = written(near.select("granule_id", "cell", "bx", "by", "o_cell", "o_bx", "o_by", (span("x") * span("x") + span("y") * span("y") <= eps * eps).alias("sure")), "near-boxes")
    sure = near.filter("sure").select("cell", "o_cell").distinct()
    open_ = near.filter("NOT sure").join(shuffled(sure), ["cell", "o_cell"], "left_anti")
    ends = boxed.select("cell", "bx", "by", "x", "y")
    open_ = open_.join(shuffled(ends), ["cell", "bx", "by"]).join(shuffled(ends.select(*[F.col(c).alias(f"o_{c}") for c in ends.columns])), ["o_cell", "o_bx", "o_by"])
    links = links.unionByName(sure.unionByName(open_.filter(distance <= eps * eps).select("cell", "o_cell").distinct()).toDF("a", "b"))

    cores = core.select("granule_id", F.col("a").alias("node")).unionByName(full.select("granule_id", F.col("cell").alias("node")))
    roots = components(links).withColumnRenamed("node", "_n")
    rooted = cores.join(shuffled(roots), F.col("node") == F.col("_n"), "left").select("granule_id", "node", F.coalesce("root", "node").alias("root"))
    number = rooted.groupBy("granule_id", "root").count().withColumn("cluster", F.row_number().over(Window.partitionBy("granule_id").orderBy("root")).cast("long") - 1)
    of_core = rooted.join(shuffled(number), ["granule_id", "root"]).select("granule_id", "node", "cluster")
    border = led.join(shuffled(of_core.withColumnRenamed("node", "to")), ["granule_id", "to"]).groupBy("granule_id", F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
    of_place = marked.withColumn("of", F.coalesce("cell", "node")).join(shuffled(of_core.withColumnRenamed("node", "of")), ["granule_id", "of"], "left").join(shuffled(border), ["granule_id", "node"], "left")
    of_place = of_place.select("granule_id", "x", "y", F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"))
    return points.join(shuffled(of_place), ["granule_id", "x", "y"]).select("granule_id", "id", "cluster")


def dbscan_corr(points: DataFrame, patches: DataFrame, eps_dist: float, eps_corr: float, min_samples: int, counters: Counters | None = None) -> DataFrame:
    """Neighbours are near and correlate by more than eps_corr; points without overlap have 0."""
    close = correlated(neighbours(points, eps_dist), patches, counters)
    close = written(close.filter(F.col("corr") > eps_corr).drop("corr"), "close-pairs")  # read for cores, links and borders
    return density_clusters(points, close, min_samples)


def mean_shift_clusters(points: DataFrame, bandwidth: float | None = None) -> DataFrame:
    """Mean shift with a flat kernel per scene; the heads of one scene are few."""

    def per_scene(df):
        df = df.sort_values("id")
        df["cluster"] = mean_shift(df[["x", "y"]].to_numpy(float), bandwidth)
        return df[["granule_id", "id", "cluster"]]

    kind = points.schema["granule_id"].dataType.simpleString()
    return points.select("granule_id", "id", F.col("x").cast("double"), F.col("y").cast("double")).groupBy("granule_id").applyInPandas(per_scene, f"granule_id {kind}, id long, cluster long")


def clustered(points: DataFrame, algorithm: str, patches: DataFrame | None = None, counters: Counters | None = None, **kw) -> DataFrame:
    """Clusters of points; those without a head (null x or y) have a null cluster."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no clustering algorithm is named {algorithm}")
    heads = points.filter("x IS NOT NULL AND y IS NOT NULL")
    if algorithm == "DBSCAN":
        out = dbscan(heads, kw.pop("eps"), kw.pop("min_samples"))
        if kw:
            raise TypeError(f"DBSCAN takes no {', '.join(kw)}")
    elif algorithm == "DBSCANCorr":
        if patches is None:
            raise ValueError("DBSCANCorr needs patches about the heads")
        out = dbscan_corr(heads, patches, kw["eps_dist"], kw["eps_corr"], kw["min_samples"], counters)
    else:
        out = mean_shift_clusters(heads, kw.get("bandwidth"))
    return points.select("granule_id", "id").join(shuffled(out), ["granule_id", "id"], "left")
