"""Every registered query of the library against its SQL."""

import pytest

from strandloom.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, rows = sql_rows(con, ORACLES[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
