import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_wave(spark):
    """A wave frame of (timestamp, signal_id, value) rows; seq is their order."""

    def make(rows):
        data = [(t, i, s, v) for i, (t, s, v) in enumerate(rows)]
        return spark.createDataFrame(data, "timestamp long, seq long, signal_id long, value_raw string")

    return make


@pytest.fixture(scope="session")
def make_names(spark):
    def make(names):
        return spark.createDataFrame(list(enumerate(names)), "signal_id long, signal_name string")

    return make
