"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# Queries of optional parts may have no SQL form; their own tests hold them against brute force.
OWN = [name for name, function in QUERIES.items() if name in CHECKS or function.__module__.startswith("ledgerlab.demo")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    assert name in CHECKS, "every query has a SQL check"
    assert compare(spark, con, SF, QUERIES[name], CHECKS[name]) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.escenario_d > 0
