from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skein.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "2",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            # Tiny inputs: interpreting is faster than compiling hundreds of plans.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.streaming.stateStore.providerClass": (
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
            ),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def workdir():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def rows(spark):
    """Small frames from tuples: rows("a bigint, b string", [(1, "x")])."""

    def make(schema, data):
        return spark.createDataFrame(data, schema)

    return make


def as_set(df, *columns):
    picked = df.select(*columns) if columns else df
    return {tuple(r) for r in picked.collect()}


@pytest.fixture(name="as_set")
def as_set_fixture():
    return as_set
