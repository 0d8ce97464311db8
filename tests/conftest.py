from __future__ import annotations

import uuid

import pytest

from millrace.session import local_session
from millrace.suite.base import fresh_database


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, memory="6g")


@pytest.fixture
def database(spark):
    return fresh_database(spark, f"t{uuid.uuid4().hex[:6]}")
