"""Every registered query of the library beside its SQL."""

import pytest

from marlspike.plans import catalogue

NAMES = sorted(set(catalogue.queries()) & set(catalogue.oracle_sql()))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, compare, name):
    compare(catalogue.queries()[name](spark, small), catalogue.oracle_sql()[name], small)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
