"""Every registered query of the core against its SQL; those without SQL must run and keep their schema."""

import pytest
from oracle import connect, rows_of, sql_rows

from factloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    cols, rows = rows_of(registry.QUERIES[name](spark, sf))
    sql_cols, want = sql_rows(con, registry.ORACLES[name])
    assert cols == sql_cols
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
