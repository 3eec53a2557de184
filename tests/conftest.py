import os

import pytest

from barloom.operators.layout import MAX_ROWS_CONF
from barloom.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def tiny_tasks(spark):
    """Let a task take only so many rows, so that small data takes the paths of large data."""

    def limit(rows: int) -> None:
        spark.conf.set(MAX_ROWS_CONF, str(rows))

    yield limit
    spark.conf.unset(MAX_ROWS_CONF)
