import pytest

from vouchlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
