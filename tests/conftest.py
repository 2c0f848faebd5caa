import pytest

from scenewright.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    ship(session)
    yield session
    session.stop()
