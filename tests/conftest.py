import pytest

from quillon.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, **{"spark.driver.memory": "6g"})
    yield session
    session.stop()
