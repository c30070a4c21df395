"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, oracle
from eviflow.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert name in catalog.SQL, "no SQL to compare with"
    ok, message = compare(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], SF_DIR)
    assert ok, message
