"""Registration of queries (imported by every ``q_*`` module; no query
modules are imported here, so any of them can be imported first)."""

from __future__ import annotations

from typing import Callable

from ..sources.fixtures import Domain
from .contract import Query, avg_round, hdiv, hround, parse_cols  # noqa: F401  (re-exported)
from .oracle_views import AS_OF, with_views  # noqa: F401  (re-exported)

REGISTRY: dict[str, Query] = {}


def register(name: str, cols: str, sql: str | None, ops: str):
    """Register ``fn(domain) -> DataFrame`` as query ``name`` with its output
    contract, its DuckDB oracle body (or None) and the survey ids it covers."""
    def deco(fn: Callable[[Domain], object]):
        def run(spark, sf_dir):
            return fn(Domain(spark, sf_dir))
        REGISTRY[name] = Query(name, run, parse_cols(cols), None if sql is None else with_views(sql), ops)
        return fn
    return deco
