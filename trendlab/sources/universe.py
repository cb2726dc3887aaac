"""The instrument table and its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .local import small_table

SCHEMA = (
    "symbol string, sector string, point_value double, currency string, contract_step double, "
    "data_source string, data_symbol string, description string, pos int"
)
_FIELDS = ("symbol", "sector", "point_value", "currency", "contract_step", "data_source", "data_symbol", "description")
_DEFAULTS = {"sector": "", "currency": "USD", "contract_step": 1.0, "data_source": "yahoo"}


def violations(universe: DataFrame) -> DataFrame:
    """``(symbol, problem)`` for every broken rule."""
    rules = F.array(
        F.when(F.coalesce("symbol", F.lit("")) == "", "symbol missing"),
        F.when(F.coalesce("sector", F.lit("")) == "", "sector missing"),
        F.when(~F.coalesce(F.col("point_value") > 0, F.lit(False)), "point_value not positive"),
        F.when(~F.coalesce(F.col("contract_step") > 0, F.lit(False)), "contract_step not positive"),
    )
    broken = universe.select("symbol", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("problem"))
    twice = universe.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return broken.unionByName(twice.select("symbol", F.lit("duplicate symbol").alias("problem")))


def with_defaults(universe: DataFrame) -> DataFrame:
    """Fill the optional columns of an instrument table."""
    out = universe
    for name, value in _DEFAULTS.items():
        filled = F.coalesce(name, F.lit(value)) if name in out.columns else F.lit(value)
        out = out.withColumn(name, filled)
    for name in ("data_symbol", "description"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def load_universe(spark: SparkSession, entries: Sequence[Mapping]) -> DataFrame:
    """Typed, checked universe from dictionaries; ``pos`` keeps the order in which they are listed."""
    rows = []
    for pos, entry in enumerate(entries):
        unknown = sorted(set(entry) - set(_FIELDS))
        if unknown:
            raise KeyError(f"unknown instrument fields: {unknown}")
        for needed in ("symbol", "point_value"):
            if needed not in entry:
                raise KeyError(f"instrument without {needed}")
        full = {**_DEFAULTS, **entry}
        text = {k: None if full.get(k) is None else str(full[k]) for k in _FIELDS}
        rows.append(
            (text["symbol"], text["sector"], float(full["point_value"]), text["currency"], float(full["contract_step"]),
             text["data_source"], text["data_symbol"], text["description"], pos)
        )
    table = small_table(spark, rows, SCHEMA)
    problem = violations(table).limit(1).collect()
    if problem:
        raise ValueError(f"universe: {problem[0]['problem']} ({problem[0]['symbol']!r})")
    return table


def vendor_table(universe: DataFrame) -> DataFrame:
    """The universe with the vendor's symbol: the override, the ``=F`` form for yahoo, or the symbol."""
    futures = F.when(F.endswith("symbol", F.lit("=F")), F.col("symbol")).otherwise(F.concat("symbol", F.lit("=F")))
    default = F.when(F.lower("data_source") == "yahoo", futures).otherwise(F.col("symbol"))
    override = F.nullif(F.col("data_symbol"), F.lit(""))
    return universe.select(
        "symbol", "sector", "point_value", "currency", "contract_step", "data_source",
        F.coalesce(override, default).alias("data_symbol"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
