import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslab.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal rows and return the values."""
    def run(build, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r["v"] for r in df.select("_i", build(df).alias("v")).orderBy("_i").collect()]

    return run
