import pytest
from oracle import connect, same

from heddle.plans import catalog, file_queries

QUERIES, SQL = {**catalog.QUERIES, **file_queries.QUERIES}, {**catalog.SQL, **file_queries.SQL}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, small, name):
    same(spark, con, QUERIES[name], SQL[name], small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
