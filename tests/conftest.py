import pytest

from spectraloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
