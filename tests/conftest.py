import pytest

from granary.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark(cpus=8, partitions=8, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
