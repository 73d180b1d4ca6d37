import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
sys.path.append(str(ROOT / "tests/stubs"))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests/stubs"), os.environ.get("PYTHONPATH", "")])  # of workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
