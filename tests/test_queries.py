import os

import pytest

from siftstone.plans.queries import ORACLE_SQL, QUERIES

from .duck import SMALL, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(isinstance(s, str) for s in e.oracle_sql().values())
