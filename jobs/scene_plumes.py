"""Plumes of scenes whose readings arrive over time: only swaths with new readings are worked on again.

    python -m jobs.scene_plumes --readings READINGS --out FOLDER --checkpoint FOLDER [--config FILE]

readings (event_id, ts, user_id, event_type, value) are one reading of one pixel each, in files that are added to a
folder. Each run takes the files that came since the last one, as a stream with a checkpoint, and ends when none is left.
Every batch

* writes its pixels to out/pixels, partitioned by swath and batch, over what an earlier try of that batch wrote;
* reads all pixels of the swaths that it touched, and no other swath's; of several readings of a pixel the latest counts;
* labels the pixels over a threshold, drops small components, and writes the swaths' partitions of out/plumes anew.

Both writes replace whole partitions and the second is derived from the first, so a batch that is run again after a failure,
or twice, gives the same tables. out/plumes has a row per scene with label 0 (its readings) and one per plume: n_pixels,
the bounds x0, y0, x1, y1 (the far ones exclusive), com_x and com_y (the centre weighted by enhancement), mean and most
(enhancement) and color (the same for a plume in every run). As a scene's row is always written, a swath whose plumes
have gone loses them in the table too.

Readings without event_id have no place: they are counted in the log and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, settings
from plumeloom.functions.strings import plume_color
from plumeloom.operators import components, geometry, masks

NAME = "scene_plumes"
PIXELS = "granule_id long, gy long, gx long, ts timestamp, v long, p long, valid boolean, swath long, batch long"
SCHEMA = "granule_id long, label long, n_pixels long, x0 long, y0 long, x1 long, y1 long, com_x double, com_y double, mean double, most long, color string, swath long"
KEYS = ["granule_id"]


def pixels(readings: DataFrame, config: dict) -> DataFrame:
    """Readings as pixels of scenes: v is the enhancement in hundredths, p the model's per mille for a plume."""
    width, size = config["width"], config["width"] * config["height"]
    px = readings.select(
        F.expr(f"event_id div {size}").alias("granule_id"),
        F.expr(f"event_id % {size} div {width}").alias("gy"),
        F.expr(f"event_id % {width}").alias("gx"),
        "ts",
        F.expr("CAST(round(value * 100) AS BIGINT)").alias("v"),
        F.expr(f"CASE WHEN ((event_id % {width} div 4) * 31 + (event_id div {4 * width}) * 17) % 7 < 2 THEN 500 ELSE 0 END + ((event_id * 7919 + user_id * 104729) % 1000) div 3").alias("p"),
        (F.col("event_type") != "error").alias("valid"),
    )
    return px.withColumn("swath", F.expr(f"granule_id div {config['scenes_a_swath']}"))


def plumes(px: DataFrame, config: dict) -> DataFrame:
    """A row per scene and per plume of pixels that may hold several readings of a place."""
    latest = px.groupBy("swath", *KEYS, "gy", "gx").agg(F.max(F.struct("ts", "v", "p", "valid")).alias("r"))
    now = latest.select("swath", *KEYS, F.col("gy").alias("y"), F.col("gx").alias("x"), "r.v", "r.p", "r.valid")
    hits = masks.over_threshold(now, "p", config["threshold"])
    found = components.without_small(components.labelled(hits, KEYS), KEYS, config["least"])
    every = now.withColumn("label", F.lit(0).cast("long")).unionByName(found.select(*now.columns, "label"))
    of = ["swath", *KEYS, "label"]
    boxes, centres = geometry.area_and_bounds(every, of), components.center_of_mass(every, of, "v")
    values = every.groupBy(*of).agg((F.sum("v").cast("double") / F.count("v")).alias("mean"), F.max("v").alias("most"))
    out = boxes.join(centres, of, "left").join(values, of).withColumnRenamed("area", "n_pixels")
    return out.withColumn("color", F.when(F.col("label") > 0, plume_color(F.col("granule_id").cast("string"), F.col("label").cast("string"))))


def run(spark: SparkSession, readings: str, out: str, checkpoint: str, config: dict | None = None) -> None:
    """Take the readings that are new and bring the plumes of their swaths up to date."""
    config = config or settings(NAME)

    def batch(rows: DataFrame, number: int) -> None:
        placed = pixels(rows.filter("event_id IS NOT NULL"), config).withColumn("batch", F.lit(number).cast("long"))
        replace(placed.repartition("swath"), f"{out}/pixels", "swath", "batch")
        stored = spark.read.schema(PIXELS).parquet(f"{out}/pixels")
        of_batch = {r["swath"]: r["count"] for r in stored.filter(F.col("batch") == number).groupBy("swath").count().collect()}  # a row per partition
        LOG.info("%s, batch %d: read %d readings of %s, wrote %d pixels", NAME, number, rows.count(), readings, sum(of_batch.values()))
        if of_batch:
            replace(plumes(stored.filter(F.col("swath").isin(*of_batch)), config).repartition("swath"), f"{out}/plumes", "swath")
            wrote = read(spark, out).filter(F.col("swath").isin(*of_batch)).count()
            LOG.info("%s, batch %d: worked on %d swaths, wrote %d scenes and plumes to %s", NAME, number, len(of_batch), wrote, out)

    readings = readings.rstrip("/")
    pattern = f"{readings[:-1]}[{readings[-1]}]"  # this path alone; as a pattern it may also be a single file
    stream = spark.readStream.schema(spark.read.parquet(readings).schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(pattern)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace(df: DataFrame, path: str, *by: str) -> None:
    """Write df over the partitions that it has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{out}/plumes")


#: The same table, with the settings beside this file.
SQL = """WITH RECURSIVE px AS (SELECT event_id // 2500 AS granule_id, event_id % 2500 // 50 AS y, event_id % 50 AS x, CAST(round(value * 100) AS BIGINT) AS v,
  CASE WHEN ((event_id % 50 // 4) * 31 + (event_id // 200) * 17) % 7 < 2 THEN 500 ELSE 0 END + ((event_id * 7919 + user_id * 104729) % 1000) // 3 AS p, event_type <> 'error' AS valid FROM events),
hit AS (SELECT *, y * 50 + x AS pos FROM px WHERE p > 400 AND valid),
reach(g, a, b) AS (SELECT granule_id, pos, pos FROM hit UNION SELECT r.g, r.a, n.pos FROM reach r JOIN hit m ON m.granule_id = r.g AND m.pos = r.b JOIN hit n ON n.granule_id = m.granule_id AND ((n.y = m.y AND abs(n.x - m.x) = 1) OR (n.x = m.x AND abs(n.y - m.y) = 1))),
rt AS (SELECT g AS granule_id, a AS pos, min(b) AS root FROM reach GROUP BY g, a),
cc AS (SELECT hit.*, dense_rank() OVER (PARTITION BY granule_id ORDER BY root) AS label, count(*) OVER (PARTITION BY granule_id, root) AS size FROM hit JOIN rt USING (granule_id, pos)),
ev AS (SELECT granule_id, 0::BIGINT AS label, y, x, v FROM px UNION ALL SELECT granule_id, label, y, x, v FROM cc WHERE size >= 4)
SELECT granule_id // 4 AS swath, granule_id, label, count(*) AS n_pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, sum(v * x)::BIGINT::DOUBLE / sum(v)::BIGINT::DOUBLE AS com_x, sum(v * y)::BIGINT::DOUBLE / sum(v)::BIGINT::DOUBLE AS com_y,
  sum(v)::BIGINT::DOUBLE / count(*)::DOUBLE AS mean, max(v) AS most, CASE WHEN label > 0 THEN upper(substr(sha256(granule_id || ':' || label), 1, 6)) END AS color FROM ev GROUP BY granule_id, label"""

if __name__ == "__main__":
    command(NAME, run, {"readings": "a folder of readings (Parquet)", "out": "the folder of pixels and plumes", "checkpoint": "the stream's checkpoint"})
