"""Signal scaling, unit conversion and contract rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .series import TRADING_DAYS, as_col


def tanh_strength(value: Column, clip: float | None = 3.0) -> Column:
    return F.tanh(value / (clip if clip and clip > 0 else 1.0))


def linear_strength(value: Column, clip: float | None = 3.0) -> Column:
    if clip is None or clip <= 0:
        raise ValueError("linear strength needs a positive clip")
    return clamp(value, clip) / clip


def strength(value: Column, clip: float | None = 3.0, method: str = "tanh") -> Column:
    if method == "tanh":
        return tanh_strength(value, clip)
    if method == "linear":
        return linear_strength(value, clip)
    raise ValueError(f"unknown strength method: {method}")


def guardrail(
    value: Column, clip: float | None = 3.0, method: str = "tanh", fill: float | None = 0.0
) -> Column:
    """Bounded strength with a neutral value where there is none."""
    scaled = strength(value, clip, method)
    return scaled if fill is None else F.coalesce(scaled, F.lit(fill))


def clamp(value: Column, bound) -> Column:
    """Limit to ``[-bound, bound]``; null stays null (``greatest``/``least`` would drop it)."""
    limit = as_col(bound)
    return F.when(value.isNotNull(), F.greatest(-limit, F.least(limit, value)))


def annualize(daily: Column, periods: int = TRADING_DAYS) -> Column:
    return daily * math.sqrt(periods)


def deannualize(annual: Column, periods: int = TRADING_DAYS) -> Column:
    return annual / math.sqrt(periods)


def finite_or_zero(value: Column) -> Column:
    """0 for null, NaN and infinities."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def to_contracts(value: Column, step) -> Column:
    """Nearest multiple of ``step``, ties to even; steps of 0 or less count as 1."""
    size = as_col(step)
    size = F.when(size > 0, size).otherwise(1.0)
    return F.rint(finite_or_zero(value) / size) * size


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
