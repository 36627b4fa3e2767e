"""Every query with an oracle against DuckDB, on the smallest tables."""

import oracle
import pytest

from lodestar import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
