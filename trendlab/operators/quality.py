"""Data-quality queries over the long price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import Keys, ffill, pct_change, series
from .calendar import duplicate_dates


def price_violations(
    prices: DataFrame, min_price: float | None = 0.0, keys: Keys = ("symbol",)
) -> DataFrame:
    """One row per problem: ``duplicate_date`` or ``min_price`` (at or below the minimum)."""
    dup = duplicate_dates(prices, keys).select(
        *keys, "ts", F.lit("duplicate_date").alias("problem"), F.lit(None).cast("double").alias("close")
    )
    if min_price is None:
        return dup
    low = prices.filter(F.col("close") <= min_price).select(
        *keys, "ts", F.lit("min_price").alias("problem"), "close"
    )
    return dup.unionByName(low)


def suspension_spans(panel: DataFrame, min_gap: int = 3, keys: Keys = ("symbol",)) -> DataFrame:
    """Runs of missing values strictly longer than ``min_gap``, with first and last date.

    Leading and trailing runs count.  ``panel`` is dense (one row per session, null where missing).
    """
    keys = list(keys)
    position = F.row_number().over(series(keys))
    missing = panel.withColumn("_pos", position).filter(F.col("close").isNull())
    island = F.col("_pos") - F.row_number().over(series(keys))
    return (
        missing.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(
            F.min("ts").alias("start"),
            F.max("ts").alias("end"),
            F.count(F.lit(1)).cast("int").alias("length"),
        )
        .filter(F.col("length") > min_gap)
        .drop("_island")
    )


def gap_violations(panel: DataFrame, max_consecutive_missing: int = 3, keys: Keys = ("symbol",)) -> DataFrame:
    """Series whose longest run of missing values exceeds the limit; a negative limit disables."""
    limit = max_consecutive_missing if max_consecutive_missing >= 0 else 2**31 - 1
    spans = suspension_spans(panel, limit, keys)
    return spans.groupBy(*keys).agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_gaps"))


def limit_moves(panel: DataFrame, threshold: float = 0.07, keys: Keys = ("symbol",)) -> DataFrame:
    """Flag absolute daily moves above the threshold; keep the dates with at least one flag.

    Missing prices are filled forward before the change is taken.
    """
    if threshold <= 0:
        raise ValueError("limit threshold must be positive")
    filled = panel.withColumn("close", ffill("close", keys))
    moved = F.coalesce(F.abs(pct_change("close", keys)) > threshold, F.lit(False))
    flagged = filled.select(*keys, "ts", moved.alias("flagged"))
    any_flag = F.max("flagged").over(Window.partitionBy("ts"))
    return flagged.withColumn("_any", any_flag).filter("_any").drop("_any")


def assert_clean(
    panel: DataFrame,
    min_price: float | None = 0.0,
    max_consecutive_missing: int = 3,
    keys: Keys = ("symbol",),
) -> None:
    """Raise on an empty panel, duplicate dates, low prices or long gaps."""
    if panel.isEmpty():
        raise ValueError("price panel is empty")
    problem = price_violations(panel, min_price, keys).limit(1).collect()
    if problem:
        raise ValueError(f"price panel has a violation: {problem[0].asDict()}")
    if max_consecutive_missing >= 0:
        gap = gap_violations(panel, max_consecutive_missing, keys).limit(1).collect()
        if gap:
            raise ValueError(f"price panel has a gap that is too long: {gap[0].asDict()}")
