"""Every core query with a SQL twin gives the twin's rows."""

import pytest

from medloom.plans import registry


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, data, duck, same):
    same(registry.queries()[name](spark, data).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


def test_no_cartesian_product(spark, data):
    """Only single-row and parameter sides are ever joined without a key."""
    for name, query in registry.queries().items():
        if name.startswith("q"):
            assert "CartesianProduct" not in query(spark, data)._jdf.queryExecution().executedPlan().toString(), name


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
