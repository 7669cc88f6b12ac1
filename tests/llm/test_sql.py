"""The queries that have SQL give the same rows as DuckDB."""

import oracle
import pytest

from strandloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert oracle.compare(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""
