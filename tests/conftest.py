import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendloom.session import local_session

    session = local_session(4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def lines_of(spark):
    """Numbered lines of one log from a list of texts."""

    def make(texts, path="/logs/x.jsonl", agent="x"):
        rows = [(path, agent, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "path STRING, agent STRING, ordinal BIGINT, line STRING")

    return make
