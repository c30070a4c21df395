"""The registered queries agree with their SQL, and the rest give a row per document."""

import pytest
from compare import compare, oracle
from llm_fixtures import spark  # noqa: F401

from eviflow.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    ok, message = compare(spark, oracle(SF_DIR), name, queries.QUERIES[name], queries.SQL[name], SF_DIR)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_a_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.select("doc_id").distinct().count() == found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
