"""The llm queries that SQL can express, against it."""

import pytest
from conftest import SMALL, rows_of

from patchloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert rows_of(queries()[name](spark, SMALL).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).fetchdf())
