import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workpulse.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def as_of():
    return dt.datetime(2024, 5, 1, 12)


@pytest.fixture
def texts(spark):
    """A function that gives a frame with one text column ``t`` and the row order ``n``."""

    def build(values):
        return spark.createDataFrame(list(enumerate(values)), "n int, t string").coalesce(1)

    return build


@pytest.fixture
def mapped(texts):
    """A function that gives the results of a column function over texts, in order."""

    def run(function, values):
        from pyspark.sql import functions as F

        rows = texts(values).select("n", function(F.col("t")).alias("out")).orderBy("n").collect()
        return [row.out for row in rows]

    return run
