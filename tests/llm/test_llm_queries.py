import pytest
from oracle import connect, same

from heddle.llm import queries


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, small, name):
    same(spark, con, queries.QUERIES[name], queries.SQL[name], small)


@pytest.mark.parametrize("name", ["p1_found", "p1_profiles", "p2_found", "p2_bodies", "p3_found", "p3_reasons"])
def test_query_gives_keys_once(spark, small, name):
    rows = queries.QUERIES[name](spark, small)
    key = [c for c in ("doc_id", "rec_id", "line_no") if c in rows.columns]
    n = rows.count()
    assert n > 0
    if name != "p2_bodies":  # one row per stored state, repeated ones included
        assert rows.select(*key).distinct().count() == n
