"""What the jobs share: settings from a small file, a session for the command line, and a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def settings(name: str, spark: SparkSession | None = None, path: str | None = None) -> dict:
    """A job's settings: those beside it, with those of a JSON file at a path that Spark reads put over them."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if path:
        own = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if unknown := own.keys() - found.keys():
            raise ValueError(f"no settings of {name}: {', '.join(sorted(unknown))}")
        found |= own
    return found


def command(name: str, job: Callable[..., None], paths: dict[str, str]) -> None:
    """Run a job with its paths and settings from the command line, in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help=f"a JSON file of settings over those in {name}.json")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, **{p: given[p] for p in paths}, config=settings(name, spark, given["config"]))
    finally:
        spark.stop()
