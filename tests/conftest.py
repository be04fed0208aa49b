import pytest

from millrace import runtime


@pytest.fixture(scope="session")
def spark():
    session = runtime.session("local[4]", 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    runtime.release(session)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
