import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
