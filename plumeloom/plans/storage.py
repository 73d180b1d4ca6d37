"""Tables that cut lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local run without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumeloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    A lost executor costs a reread of these files, not the work that made them. Only columns
    that a later step uses are read. The files live as long as the checkpoint folder, or until
    dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join by shuffle and sort.

    A plan takes a table for as large as its files, and exploded rows for one. Files of whole numbers in order are a small
    part of their rows, so tables of any length seem small enough for a broadcast, which passes them whole through
    the driver.
    """
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let the cluster delete the shuffle files of queries that are done.

    Executors keep them until the driver's JVM has collected the query that they belong to, which in
    a job of many queries may be at its end. The last query is held until another one has run, and what
    listeners and this process still refer to takes a moment to go. Nothing is lost: finished
    queries were written.
    """
    spark.range(1).count()
    time.sleep(0.2)
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)
