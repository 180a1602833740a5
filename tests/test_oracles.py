"""Every panel and market query that SQL can express, against DuckDB."""

import pytest

from quantloom.plans import catalog
from tests.oracle import SMALL, agree, connect

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    agree(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
