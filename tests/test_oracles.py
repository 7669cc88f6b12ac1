"""Every query that has SQL gives the same rows as DuckDB; those without it give rows with the same schema each time."""

import os

import oracle
import pytest

from strandloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    if name in SQL:
        assert oracle.compare(df, duck, SQL[name]) == ""
    else:
        assert df.columns and len(df.collect()) >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
