import pytest

from quantloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
