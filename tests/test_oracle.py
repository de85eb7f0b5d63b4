"""Every query of the core against its SQL, and the rest for rows."""

import pytest
from oracle import compare, connect

from grainmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns)) and (df.count() > 0 or name == "overflow_blocks")
