"""Cash, net asset value and costs per session.

Amounts are summed as decimals, so a ledger that is computed twice has the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import exact_sum

LEDGER_COLUMNS = ("nav", "cash", "asset_value", "pnl", "trading_cost", "roll_cost", "total_cost")


def daily_costs(fills: DataFrame) -> DataFrame:
    """Spent cash and costs per ``(run_id, ts)``; reasons starting with "roll" are roll costs."""
    roll = F.col("reason").startswith("roll")
    return fills.groupBy("run_id", "ts").agg(
        exact_sum(F.col("notional") + F.col("cost")).alias("spent"),
        exact_sum(F.when(roll, 0.0).otherwise(F.col("cost"))).alias("trading_cost"),
        exact_sum(F.when(roll, F.col("cost")).otherwise(0.0)).alias("roll_cost"),
    )


def asset_values(positions: DataFrame) -> DataFrame:
    """Market value of all holdings per ``(run_id, ts)``: one row for every session."""
    value = F.col("pos") * F.col("close") * F.col("point_value")
    return positions.groupBy("run_id", "ts").agg(exact_sum(value).alias("asset_value"))


def ledger(positions: DataFrame, fills: DataFrame, starting_nav: DataFrame | float = 1_000_000.0) -> DataFrame:
    """One row per run and session.  ``starting_nav`` may be a table ``(run_id, starting_nav)``."""
    rows = asset_values(positions).join(daily_costs(fills), ["run_id", "ts"], "left")
    if isinstance(starting_nav, DataFrame):
        rows = rows.join(starting_nav.select("run_id", "starting_nav"), "run_id")
        start: Column = F.col("starting_nav")
    else:
        start = F.lit(float(starting_nav))
    by_run = Window.partitionBy("run_id").orderBy("ts")
    spent = F.sum(F.coalesce("spent", F.lit(0.0))).over(by_run.rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0.0)
    rows = rows.withColumn("cash", start - spent).withColumn("nav", F.col("cash") + F.col("asset_value"))
    return rows.select(
        "run_id",
        "ts",
        "nav",
        "cash",
        "asset_value",
        F.coalesce(F.col("nav") - F.lag("nav").over(by_run), zero).alias("pnl"),
        F.coalesce("trading_cost", zero).alias("trading_cost"),
        F.coalesce("roll_cost", zero).alias("roll_cost"),
        (F.coalesce("trading_cost", zero) + F.coalesce("roll_cost", zero)).alias("total_cost"),
    )


def identity_violations(ledger_rows: DataFrame, contributions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sessions where ``nav = cash + asset_value`` or ``pnl = contributions - costs`` fails."""
    earned = contributions.groupBy("run_id", "ts").agg(F.sum("pnl").alias("earned"))
    rows = ledger_rows.join(earned, ["run_id", "ts"], "left")
    gap = F.abs(F.col("nav") - F.col("cash") - F.col("asset_value"))
    drift = F.abs(F.col("pnl") - (F.coalesce("earned", F.lit(0.0)) - F.col("total_cost")))
    return rows.withColumn("nav_gap", gap).withColumn("pnl_gap", drift).filter(
        (F.col("nav_gap") > tolerance) | (F.col("pnl_gap") > tolerance)
    )
