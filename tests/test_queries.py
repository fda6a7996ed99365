import pytest
from oracle import both, connect

from quire import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    got_columns, want_columns, got, want = both(spark, con, Q.QUERIES[name], Q.ORACLE_SQL[name], sf_dir)
    assert got_columns == want_columns
    assert got == want
