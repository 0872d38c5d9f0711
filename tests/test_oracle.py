from __future__ import annotations

import pytest

from quire.plans import registry

from .oracle import compare, connection

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, small, con):
    assert compare(registry.queries()[name](spark, small), SQL[name], con) == ""


def test_queries_without_sql(spark, small):
    for name in set(registry.queries()) - set(SQL):
        assert registry.queries()[name](spark, small).count() > 0
