"""Every query with a statement agrees with DuckDB on the smallest tables; every other one runs."""

import pytest
from compare import connect, difference

import clinispan.plans.oracles as oracles
import clinispan.plans.queries as engine

QUERIES, SQL = engine.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, con, sf, name):
    assert difference(spark, con, sf, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
