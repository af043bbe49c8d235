import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickflow.runtime import local_session, remove_stage_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_stage_tables(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows of a small hand-made frame: frame("a long, b double", [(1, 2.0)])."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
