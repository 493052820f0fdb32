"""Every registered query of the engine runs, and has the rows of its SQL."""

import pytest

from resight.plans import queries as plans
from tests.oracle import by_sql, canonical


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, small, name):
    df = plans.queries()[name](spark, small)
    found = df.toPandas()
    if sql := plans.oracle_sql().get(name):
        expected = by_sql(sql, small)
        assert sorted(found.columns) == sorted(expected.columns)
        assert canonical(found) == canonical(expected)


def test_entry_names(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
