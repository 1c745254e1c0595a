import pytest

from verdigris.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(cores=2, shuffle_partitions=2, memory="2g")
    yield s
    s.stop()
