"""Output contract shared by a registered query and its DuckDB oracle.

A query declares its output columns once as ``"name:type"`` (type codes:
``s`` string, ``i`` bigint, ``d`` double rounded to 6 places, ``b`` boolean,
``t`` timestamp without zone, ``dt`` date).  The Spark side projects and
casts to exactly that; the oracle text is wrapped in a SELECT doing the same
casts, so names and types agree column for column.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK_T = {"s": "string", "i": "bigint", "d": "double", "b": "boolean",
            "t": "timestamp_ntz", "dt": "date"}
_DUCK_T = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN",
           "t": "TIMESTAMP", "dt": "DATE"}
DIGITS = 6


def parse_cols(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split():
        name, _, t = item.partition(":")
        out.append((name, t or "s"))
    return out


def spark_project(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    exprs = []
    for name, t in cols:
        c = F.col(name).cast(_SPARK_T[t])
        if t == "d":
            c = F.round(c, DIGITS)
        exprs.append(c.alias(name))
    return df.select(*exprs)


def duck_wrap(sql: str, cols: list[tuple[str, str]]) -> str:
    exprs = []
    for name, t in cols:
        e = f'CAST(q."{name}" AS {_DUCK_T[t]})'
        if t == "d":
            e = f"ROUND({e}, {DIGITS})"
        exprs.append(f'{e} AS "{name}"')
    return "SELECT " + ", ".join(exprs) + f"\nFROM (\n{sql}\n) q"


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    cols: list[tuple[str, str]]
    sql: str | None
    ops: str  # survey IDs covered

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark_project(self.fn(spark, sf_dir), self.cols)

    def oracle(self) -> str | None:
        return None if self.sql is None else duck_wrap(self.sql, self.cols)


# --- exact half-up rounding in DuckDB (its decimal division yields DOUBLE) ----

def hdiv(num: str, den: str) -> str:
    """Integer division of non-negative integers, rounded half up."""
    return f"((CAST(({num}) AS HUGEINT) * 2 + ({den})) // (2 * ({den})))"


def hround(num: str, den: str, d: int) -> str:
    """ROUND(num / den, d) exactly, for non-negative integer num and den."""
    k = 10 ** d
    return f"({hdiv(f'CAST(({num}) AS HUGEINT) * {k}', den)} / {k}.0)"


def avg_round(total_units: str, n: str, scale: int, d: int) -> str:
    """ROUND(AVG(x), d) for a decimal x with ``scale`` places whose exact sum,
    in units of 10^-scale, is ``total_units``: AVG keeps scale+4 places
    (half up) and is then rounded to ``d``."""
    a4 = hdiv(f"CAST(({total_units}) AS HUGEINT) * 10000", n)
    step = 10 ** (scale + 4 - d)
    return f"({hdiv(a4, str(step))} / {10 ** d}.0)"
