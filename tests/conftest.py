from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("jobtide-tests")
               .config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def now():
    return dt.datetime(2024, 1, 16)


@pytest.fixture(scope="session")
def make_jobs(spark, now):
    """Jobs from (id, type, seconds from now or None, lock[, data]) tuples."""
    from jobtide.schema import JOB

    def make(*rows):
        full = []
        for r in rows:
            id_, type_, secs, lock, *data = r
            when = None if secs is None else (
                secs if isinstance(secs, dt.datetime) else now + dt.timedelta(seconds=secs))
            full.append((id_, type_, when, lock, data[0] if data else "x"))
        return spark.createDataFrame(full, JOB)

    return make
