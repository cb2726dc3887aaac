"""Window helpers for daily series keyed by ``keys`` and ordered by ``ts``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]

TRADING_DAYS = 252


def as_col(value) -> Column:
    """A Column as it is; anything else as a literal (so parameters may be scenario columns)."""
    return value if isinstance(value, Column) else F.lit(value)


def series(keys: Keys, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def upto(keys: Keys, ts: str = "ts") -> WindowSpec:
    """First row of the series up to the current one."""
    return series(keys, ts).rowsBetween(Window.unboundedPreceding, 0)


def trailing(keys: Keys, n: int, ts: str = "ts") -> WindowSpec:
    """The last ``n`` rows including the current one."""
    return series(keys, ts).rowsBetween(-(n - 1), 0)


def cross_section(keys: Keys, ts: str = "ts") -> WindowSpec:
    """All instruments of one run on one date: bounded by the size of the universe."""
    return Window.partitionBy(*[k for k in keys if k != "symbol"], ts)


def shift(value: str | Column, n: int, keys: Keys, default=None, ts: str = "ts") -> Column:
    return F.lag(value, n, default).over(series(keys, ts))


def ffill(value: str | Column, keys: Keys, ts: str = "ts") -> Column:
    return F.last(value, ignorenulls=True).over(upto(keys, ts))


def bfill(value: str | Column, keys: Keys, ts: str = "ts") -> Column:
    """Next known value.

    Written as "last value seen in reverse order": a growing frame is evaluated in one pass, while
    a frame that runs from the current row to the end is re-read for every row.
    """
    backwards = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    frame = backwards.rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(frame)


def first_known(value: str | Column, keys: Keys, ts: str = "ts") -> Column:
    """First value of the whole series: what a backward fill puts into its leading gap."""
    whole = series(keys, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(value, ignorenulls=True).over(whole)


def rolling(
    aggregate: Callable[[str | Column], Column],
    value: str | Column,
    keys: Keys,
    n: int,
    min_periods: int | None = None,
    ts: str = "ts",
) -> Column:
    """``aggregate`` over the last ``n`` rows, null until ``min_periods`` values are present."""
    frame = trailing(keys, n, ts)
    needed = n if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= needed, aggregate(value).over(frame))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the divisor is 0 (also under ANSI mode)."""
    return top / F.nullif(bottom, F.lit(0.0))


def pct_change(value: str, keys: Keys, ts: str = "ts") -> Column:
    return ratio(F.col(value), F.lag(value).over(series(keys, ts))) - 1


def exact(amount: Column | str) -> Column:
    """An amount as a decimal with nine places: sums of such have the same digits in whatever order a shuffle brings the terms."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast("decimal(28,9)")


def exact_sum(amount: Column | str) -> Column:
    """The sum of an amount's decimals, as a floating-point number again."""
    return F.sum(exact(amount)).cast("double")


def with_settings(rows: DataFrame, settings: DataFrame, number: str, parts: int = 1) -> DataFrame:
    """Every row with every setting of its ``window_id``.

    A plain sweep has one window, so one join key. ``parts`` deals its settings to so many keys by their ``number``, for
    the case that they are too many to be broadcast; each part gets its own copy of the rows.
    """
    if parts == 1:
        return rows.join(settings, "window_id")
    dealt = settings.withColumn("_part", F.pmod(F.col(number), F.lit(parts)))
    return rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["window_id", "_part"]).drop("_part")
