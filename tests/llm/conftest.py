import pytest

from clientlens.llm.common import documents, labels


@pytest.fixture(scope="session")
def corpus(spark, data):
    return documents(spark, data)


@pytest.fixture(scope="session")
def marks(spark, data):
    return labels(spark, data)
