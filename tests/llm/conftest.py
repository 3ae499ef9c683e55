import pytest

from chatrisk.llm.batches import tuned


@pytest.fixture(scope="session")
def session(spark):
    return tuned(spark)


@pytest.fixture(scope="session")
def table(session):
    def make(rows, schema):
        return session.createDataFrame(rows, schema)

    return make
