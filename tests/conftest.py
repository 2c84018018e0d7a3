import pytest

from tarn.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    yield session
