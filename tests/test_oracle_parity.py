"""Every registered query with an oracle must equal its DuckDB SQL (sf0.001).

The driver runs the same comparison at sf0.01; ``tools/oracle_check.py``
reproduces it locally.
"""

import math

import pytest

from edusignal.plans.registry import REGISTRY

from .conftest import SMALL

WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql is not None)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, duck, name):
    q = REGISTRY[name]
    sdf = q.run(spark, SMALL)
    srows = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=_key)
    cur = duck.execute(q.oracle())
    assert [c[0] for c in cur.description] == sdf.columns
    drows = sorted((tuple(_norm(v) for v in r) for r in cur.fetchall()), key=_key)
    assert len(srows) == len(drows)
    assert srows == drows


def test_every_query_declares_survey_ids():
    for name, q in REGISTRY.items():
        assert q.ops.strip(), name


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
