"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from corpuscle.plans import registry
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, tmp_path, name):
    _, missing, extra = differences(registry.QUERIES[name](spark, DATA), registry.SQL[name], str(tmp_path / name))
    assert (missing, extra) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0
