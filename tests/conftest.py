import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from urlsieve.session import local_session

    session = local_session("tests", cpus="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con(sf):
    from compare import duck

    return duck(sf)


def url_frame(spark, urls, **extra):
    rows = [(i, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "row_id long, url string")
