import pytest

from graintable.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "6g")
    yield session
    session.stop()
