"""Every registered query against its SQL on the end state."""

import pytest

from deltaview import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, duck, rows_of):
    assert rows_of(catalogue.queries()[name](spark, sf)) == rows_of(duck.execute(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, sf):
    """Filters and pruned columns reach the scan."""
    plan = catalogue.queries()["filter_eq"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,77)" in plan or "o_custkey" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1]
