"""Queries with SQL, against DuckDB on the same tables."""

import pytest

from edusignal.llm.queries import ORACLES, QUERIES

from ..conftest import SMALL


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(map(str, map(norm, r))) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, map(norm, r))) for r in cur.fetchall())
