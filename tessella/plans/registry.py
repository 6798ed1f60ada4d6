"""Registry that keeps a Spark query next to its SQL twin.

A column spec such as ``"ticker date:d ret:r n:i"`` fixes name, order and type on
both sides: ``r`` rounds a double, ``i`` is a 64-bit integer, ``d`` prints a date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.ctes import with_ctes
from tessella.sources.domain import Domain


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Domain], DataFrame]
    spec: tuple[tuple[str, str], ...]
    digits: int
    body: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Domain(spark, sf_dir))
        return df.select(*[_spark_col(c, t, self.digits) for c, t in self.spec])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        cols = ", ".join(_sql_col(c, t, self.digits) for c, t in self.spec)
        return with_ctes(f"SELECT {cols} FROM (\n{self.body.strip()}\n) AS q")


def _spark_col(c: str, t: str, digits: int):
    x = F.col(f"`{c}`")
    if t == "r":
        x = x.cast("double")
        x = F.round(F.when(~F.isnan(x), x) + _OFF_HALF * 10.0**-digits, digits)
    elif t == "i":
        x = x.cast("bigint")
    elif t == "d":
        x = F.date_format(x, "yyyy-MM-dd")
    else:
        x = x.cast("string")
    return x.alias(c)


def _sql_col(c: str, t: str, digits: int) -> str:
    q = f'"{c}"'
    if t == "r":
        return f"round(CASE WHEN NOT isnan(CAST({q} AS DOUBLE)) THEN CAST({q} AS DOUBLE) END + {_OFF_HALF}e-{digits}, {digits}) + 0.0 AS {q}"
    if t == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if t == "d":
        return f"CAST(CAST({q} AS DATE) AS VARCHAR) AS {q}"
    return f"CAST({q} AS VARCHAR) AS {q}"


# Added before rounding on both sides, so that an exact half (1060.2115625) does not depend
# on how an engine rounds halves.
_OFF_HALF = 0.037


def draw_sql(seed, *cols):
    """The draw numbers of the operators in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 1, 13) AS BIGINT)"


CATALOG: dict[str, Query] = {}


def query(key: str, spec: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(domain) -> DataFrame`` under ``key``."""
    parsed = tuple((p.split(":")[0], p.split(":")[1] if ":" in p else "s") for p in spec.split())

    def add(fn):
        if key in CATALOG:
            raise ValueError(f"query {key} registered twice")
        CATALOG[key] = Query(key, fn, parsed, digits, sql)
        return fn

    return add
