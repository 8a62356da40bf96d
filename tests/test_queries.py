"""Every registered query runs, and equals its SQL where it has one."""

import pytest

from docloom.plans import registry
from tests.conftest import SF
from tests.oracle import connect, normal


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    # numbers may come as int or float where a column has nulls
    assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
