import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=4, memory="4g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
