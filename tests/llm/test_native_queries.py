"""Queries that SQL can express, against DuckDB."""

import pytest

from tests.compare import duck, same
from tidetable.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])
