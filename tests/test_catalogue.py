"""Every query of the base catalogue against its SQL."""

import pytest
from conftest import SMALL, rows_of

from patchloom.plans import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_matches_sql(spark, duck, name):
    assert rows_of(all_queries()[name](spark, SMALL).toPandas()) == rows_of(duck.execute(all_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
