"""Queries against their SQL over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from oracle import both, connect  # noqa: E402

from quire.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got_columns, want_columns, got, want = both(spark, connect(sf_dir), Q.QUERIES[name], Q.ORACLE_SQL[name], sf_dir)
    assert got_columns == want_columns
    assert got == want
