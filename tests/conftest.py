import pytest

from sightline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
