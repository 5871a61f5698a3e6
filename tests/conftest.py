import os
import sys
from datetime import timedelta

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from pyspark.sql import SparkSession  # noqa: E402

from helpers import SCHEMA, T0  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .appName("loglane-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def logs(spark):
    """Log table from ``(service, text)`` or ``(service, text, seconds)`` tuples."""

    def make(rows, step=1.0):
        data = []
        for i, r in enumerate(rows):
            at = r[2] if len(r) > 2 else i * step
            data.append((i + 1, r[0], r[1], T0 + timedelta(seconds=at)))
        return spark.createDataFrame(data, SCHEMA)

    return make
