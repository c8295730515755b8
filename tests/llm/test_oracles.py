"""Queries that SQL can express, against DuckDB on the same tables."""

import pytest

from lamella.llm import queries as Q
from lamella.session import ship
from tests.conftest import SF, duck, same_rows


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    ship(spark)
    same_rows(Q.QUERIES[name](spark, SF).toPandas(), duck(SF, Q.ORACLE_SQL[name]))
