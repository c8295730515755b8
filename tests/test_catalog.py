"""Every voxel query against its SQL, run by DuckDB on the same tables."""

import pytest

from lamella import catalog
from tests.conftest import SF_SMALL, duck, same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SF_SMALL).toPandas(), duck(SF_SMALL, catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_repeats(spark, name):
    first, second = (catalog.QUERIES[name](spark, SF_SMALL).toPandas() for _ in range(2))
    assert len(first) and sorted(map(tuple, first.values.tolist())) == sorted(map(tuple, second.values.tolist()))


def test_no_sql_without_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
