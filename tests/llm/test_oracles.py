"""Queries with SQL equal DuckDB on the same tables."""

import pytest

from spendlens.llm import queries
from spendlens.plans.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    found = compare(spark, sf_dir, [name], con=duck(sf_dir), verbose=False)[name]
    assert found.get("match"), found
