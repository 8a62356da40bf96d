"""Queries that SQL can state equal their SQL."""

import pytest

from docloom.llm import queries
from tests.conftest import SF
from tests.oracle import connect, normal


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in normal(got)] == [tuple(map(str, r)) for r in normal(want)]
