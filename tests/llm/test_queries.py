"""The queries with SQL against DuckDB."""

import pytest

from simquarry.llm import oracle, queries
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == sql_rows(oracle.SQL[name], data)
