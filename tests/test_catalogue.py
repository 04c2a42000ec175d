"""Every query with SQL agrees with DuckDB on the same tables."""

import pytest

from lumagrid.plans import catalogue

from .conftest import DATA, same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, DATA), duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert rows and all(len(r["art"]) == 5 * 11 - 1 for r in rows)
