"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    verdict, _, rows = compare(spark, con, name, FOLDER)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_entry(spark):
    assert entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
