"""Every query with SQL gives the same rows; the others give rows."""

import pytest

from oracle import DATA, compare
from weftline import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
