"""Every named query that is not a stream, against its SQL twin on the smallest data."""

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
BATCH = sorted(n for n in queries() if n in oracle_sql() and not n.startswith(("T", "S1", "S8")))


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", BATCH)
def test_query(spark, con, name):
    ok, note = compare(spark, con, DATA, name)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 1000
