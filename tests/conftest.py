import os

import pytest

os.environ.setdefault("BENCH_CPUS", "4")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stackmill.session import build_session

    session = build_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
