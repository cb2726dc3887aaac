"""The daily market panel derived from ``lineitem`` and ``part``.

The provided tables hold no prices.  One day of one part type (or brand) is a bar: its price is an
index that accumulates the day's mean discount in whole basis points, its volume the quantity sold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calendar
from ..sources import sinks
from ..sources.universe import load_universe

# Instruments of the type panel (symbol, sector, point value), in universe order.
INSTRUMENTS = (
    ("ECONOMY", "Core", 50.0),
    ("LARGE", "Size", 20.0),
    ("MEDIUM", "Size", 100.0),
    ("PROMO", "Promo", 1000.0),
    ("SMALL", "Size", 10.0),
    ("STANDARD", "Core", 25.0),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """Weekday line items with their symbol: ``(symbol, ts, disc, tax, qty)``, rates in percent."""
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("ts"),
        pct("l_discount").alias("disc"),
        pct("l_tax").alias("tax"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("symbol"))
    joined = items.filter(F.weekday("ts") < 5).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("symbol", "ts", "disc", "tax", "qty")


def bars(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """``(symbol, ts, high, low, close, volume)``; days without a sale have no row.

    Source rows are summed per symbol and day before anything is ordered, so a symbol that holds a
    third of all line items still ends as one row per day.
    """
    mean = F.sum("disc").cast("double") / (F.lit(100.0) * F.count(F.lit(1)))
    daily = trades(spark, sf_dir, by).groupBy("symbol", "ts").agg(
        F.floor(F.lit(10000.0) * (mean - 0.05)).cast("bigint").alias("bp"),
        (F.max("disc").cast("double") / 1000).alias("up"),
        (F.max("tax").cast("double") / 1000).alias("dn"),
        F.sum("qty").alias("volume"),
    )
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    level = F.exp(F.sum("bp").over(w).cast("double") / 10000.0)
    priced = daily.withColumn("close", F.round(100.0 * level, 6))
    return priced.select(
        "symbol",
        "ts",
        (F.col("close") * (1 + F.col("up"))).alias("high"),
        (F.col("close") * (1 - F.col("dn"))).alias("low"),
        "close",
        "volume",
    )


def bounds(rows: DataFrame) -> tuple:
    """First and last date of a panel as scalar subqueries."""
    edge = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return edge.select("a").scalar(), edge.select("b").scalar()


def _ship_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday ship dates: the panel's bounds from a scan of one column."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ts")).filter(F.weekday("ts") < 5)


def stored_bars(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """The bars written once, for plans that use them in several places."""
    return sinks.stored(bars(spark, sf_dir, by), f"bars-{by}")


def gaps(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """Dense ``(symbol, ts, close)`` with nulls on the sessions without a bar."""
    return calendar.align(bars(spark, sf_dir, by), *bounds(_ship_dates(spark, sf_dir)), fill=False)


def aligned(spark: SparkSession, sf_dir: str, by: str = "p_type", carry: Sequence[str] = ()) -> DataFrame:
    """Dense ``(symbol, ts, close)`` filled forward."""
    return calendar.align(bars(spark, sf_dir, by), *bounds(_ship_dates(spark, sf_dir)), carry=carry)


def stored_panel(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """The aligned panel with the day's volume as ``adv``, written once."""
    rows = aligned(spark, sf_dir, by, carry=("volume",))
    return sinks.stored(rows.withColumnRenamed("volume", "adv"), f"panel-{by}")


def universe(spark: SparkSession) -> DataFrame:
    return load_universe(
        spark, [{"symbol": s, "sector": sector, "point_value": pv, "contract_step": 1.0} for s, sector, pv in INSTRUMENTS]
    )


# The same panel in SQL ------------------------------------------------------------------------

_BARS = """
with recursive trades as (
  select {by} as symbol, cast(l_shipdate as date) as ts, cast(round(l_discount*100) as bigint) as disc,
    cast(round(l_tax*100) as bigint) as tax, cast(l_quantity as bigint) as qty
  from lineitem join part on l_partkey = p_partkey where isodow(l_shipdate) between 1 and 5),
daily as (
  select symbol, ts, cast(floor(10000.0*(cast(sum(disc) as double)/(100.0*count(*)) - 0.05)) as bigint) as bp,
    cast(max(disc) as double)/1000 as up, cast(max(tax) as double)/1000 as dn, cast(sum(qty) as bigint) as volume
  from trades group by 1, 2),
levels as (
  select *, round(100.0*exp(cast(sum(bp) over (partition by symbol order by ts rows unbounded preceding) as double)/10000.0), 6) as close
  from daily),
bars as (select symbol, ts, close*(1+up) as high, close*(1-dn) as low, close, volume from levels),
edges as (select min(ts) as a, max(ts) as b from bars),
sess as (select cast(d as date) as ts from (select unnest(generate_series(a, b, interval 1 day)) as d from edges) where isodow(d) <= 5),
gaps as (
  select s.symbol, t.ts, b.close from (select distinct symbol from bars) s cross join sess t
  left join bars b on b.symbol = s.symbol and b.ts = t.ts),
px as (
  select symbol, ts, last_value(close ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as close
  from gaps),
pxi as (select *, row_number() over (partition by symbol order by ts) - 1 as i from px)
"""


def sql(final: str, *ctes: str, by: str = "p_type") -> str:
    """The panel's common table expressions, more of them, and the final select."""
    return ",\n".join([_BARS.format(by=by).strip(), *[c.strip() for c in ctes]]) + "\n" + final
