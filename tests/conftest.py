import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def hot(spark):
    """Lower the hot-key thresholds so that small fixtures take the sliced path."""
    spark.conf.set("spark.tidemark.hot.floor", "20")
    yield
    spark.conf.unset("spark.tidemark.hot.floor")


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
