import os
import sys

import pytest

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(here), here]

from moveproof import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "moveproof-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def rows(spark):
    """Evaluate columns of a one-column frame of values: rows(values, col -> Column)."""
    def run(values, expression, dtype="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
        return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]
    return run
