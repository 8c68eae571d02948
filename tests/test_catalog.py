"""A part of the registered queries against their SQL; `python -m tests.check` runs all of them."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
PREFIXES = ("a0", "b0", "b1", "b2", "c0", "c18", "c19", "f0", "e24", "e27_mine_thr", "h0", "h1", "i01", "i02", "i08", "i14", "k0")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith(PREFIXES)])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["pid"] == 0
