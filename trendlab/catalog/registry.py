"""The registry: a Spark plan, its output columns and, where SQL can say it, the same in SQL.

Output columns are written as ``"name kind"``: ``s`` text, ``d`` date (as ISO text), ``i`` whole
number, ``b`` boolean, the number of decimals of a float, or ``m3`` for amounts of money.  Both sides
get the same projection.  Amounts are sums of six-decimal prices, so some lie exactly between two
thousandths; both sides take them as decimals and round those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    key: str
    plan: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(spark, sf_dir).select(*[_spark_column(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_column(n, k) for n, k in self.columns)
        return f"select {cols} from (\n{self.sql}\n) as result"


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        out = c.cast("string")
    elif kind == "d":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind == "i":
        out = c.cast("bigint")
    elif kind == "b":
        out = c.cast("boolean")
    elif kind == "m3":
        out = F.round(c.cast("decimal(28,6)"), 3).cast("double") + F.lit(0.0)
    else:
        out = F.round(c.cast("double"), int(kind)) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0
    return out.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f'cast("{name}" as varchar) as "{name}"'
    if kind == "d":
        return f"strftime(\"{name}\", '%Y-%m-%d') as \"{name}\""
    if kind == "i":
        return f'cast("{name}" as bigint) as "{name}"'
    if kind == "b":
        return f'cast("{name}" as boolean) as "{name}"'
    if kind == "m3":
        return f'cast(round(cast("{name}" as decimal(28,6)), 3) as double) + 0.0 as "{name}"'
    return f'round(cast("{name}" as double), {kind}) + 0.0 as "{name}"'


REGISTRY: dict[str, Query] = {}


def register(key: str, columns: str, sql: str | None = None):
    """Decorator for ``plan(spark, sf_dir)``; ``columns`` like ``"symbol s, ts d, close 6"``."""
    pairs = tuple(tuple(part.split()) for part in columns.split(","))

    def add(plan):
        REGISTRY[key] = Query(key, plan, pairs, sql)
        return plan

    return add
