import pytest

from folioflow.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
