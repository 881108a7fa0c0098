"""Every registered query with SQL gives the SQL's rows, on the smallest tables."""

import pytest
from compare import expected, found

from graphtide.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert found(registry.queries()[name](spark, small)) == expected(SQL[name], small)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert [r["b"] for r in rows] == sorted((r["b"] for r in rows), reverse=True)
    assert set(__spark_entry__.queries()) >= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
