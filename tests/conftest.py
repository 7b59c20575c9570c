import pytest

from lanternlog.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session
