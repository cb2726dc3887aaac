"""Trading sessions, alignment to sessions and gap filling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Keys, ffill, first_known, series, upto


def _day(value) -> Column:
    return value.cast("date") if isinstance(value, Column) else F.lit(str(value)[:10]).cast("date")


def explode_sessions(
    rows: DataFrame, start, end, holidays: Iterable | DataFrame | None = None, ts: str = "ts"
) -> DataFrame:
    """Give every row of ``rows`` one copy per weekday in ``[start, end]``, holidays left out.

    ``start``/``end`` are dates or Columns (a column of ``rows`` or a scalar subquery), so the
    calendar is generated next to the keys instead of being cross joined to them.
    """
    out = rows.withColumn(ts, F.explode(F.sequence(_day(start), _day(end)))).filter(
        F.weekday(ts) < 5
    )
    return without_holidays(out, holidays, ts)


def without_holidays(rows: DataFrame, holidays: Iterable | DataFrame | None, ts: str = "ts") -> DataFrame:
    if holidays is None:
        return rows
    if isinstance(holidays, DataFrame):
        days = holidays.select(F.to_date(F.col(holidays.columns[0])).alias(ts)).distinct()
        return rows.join(days, ts, "left_anti")
    return rows.filter(~F.col(ts).isin(_listed(holidays)))


def _listed(holidays: Iterable) -> list[Column]:
    return [F.lit(day).cast("date") for day in sorted({str(h)[:10] for h in holidays})]


def sessions(spark, start, end, holidays=None) -> DataFrame:
    """The session table ``(ts)`` between two dates, both included."""
    return explode_sessions(spark.range(1), start, end, holidays).select("ts")


def align(
    prices: DataFrame,
    start,
    end,
    holidays=None,
    keys: Keys = ("symbol",),
    value: str = "close",
    fill: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Dense panel: one row per series and session, gaps filled forward, leading gaps null.

    Rows that fall on no session count as missing.  ``fill=False`` keeps the gaps (for quality
    checks); ``carry`` names columns that keep their value on their own date only.

    Each row stands for the days up to the next row of its series, so one ordered pass per series
    expands it; there is no grid of series and dates to build and join.
    """
    keys = list(keys)
    first_day, last_day = _day(start), _day(end)
    rows = prices.select(*keys, F.to_date("ts").alias("ts"), value, *carry)
    on_session = F.col("ts").between(first_day, last_day) & (F.weekday("ts") < 5)
    if isinstance(holidays, DataFrame):
        closed = holidays.select(F.to_date(F.col(holidays.columns[0])).alias("ts")).distinct()
        rows = rows.join(closed.withColumn("_closed", F.lit(True)), "ts", "left")
        on_session = on_session & F.col("_closed").isNull()
    elif holidays is not None:
        on_session = on_session & ~F.col("ts").isin(_listed(holidays))
    rows = rows.withColumn(value, F.when(on_session, F.col(value)))

    w = series(keys)
    known = F.last(value, ignorenulls=True).over(upto(keys)) if fill else F.col(value)
    spans = rows.select(
        *keys,
        F.col("ts").alias("_own"),
        known.alias(value),
        *carry,
        F.greatest("ts", first_day).alias("_lo"),
        F.least(F.coalesce(F.date_sub(F.lead("ts").over(w), 1), last_day), last_day).alias("_hi"),
        F.lag("ts").over(w).isNull().alias("_head"),
    )
    # The first row also stands for the days before it, where nothing is known yet.
    before = F.least(F.date_sub(F.col("_own"), 1), last_day)
    no_days = F.array().cast("array<date>")
    lead_in = F.when(F.col("_head") & (before >= first_day), F.sequence(first_day, before)).otherwise(no_days)
    stretch = F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi")).otherwise(no_days)
    dense = spans.withColumn("ts", F.explode(F.concat(lead_in, stretch))).filter(F.weekday("ts") < 5)
    holds = F.col("ts") >= F.col("_own") if fill else F.col("ts") == F.col("_own")
    out = dense.select(
        *keys,
        "ts",
        F.when(holds, F.col(value)).alias(value),
        *[F.when(F.col("ts") == F.col("_own"), F.col(c)).alias(c) for c in carry],
    )
    return without_holidays(out, holidays)


def duplicate_dates(prices: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Violations of "one row per series and date" (order means nothing in a Spark table)."""
    counts = prices.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1")


def validate(prices: DataFrame, keys: Keys = ("symbol",)) -> None:
    found = duplicate_dates(prices, keys).limit(1).collect()
    if found:
        raise ValueError(f"more than one price per date, for example {found[0].asDict()}")


def complete_panel(panel: DataFrame, scope: Keys = (), value: str = "close") -> DataFrame:
    """Drop empty series, fill forward, keep the dates on which every remaining series has a value.

    ``scope`` names the columns that separate independent panels (for example ``run_id``).  On a
    dense panel "every series has a value" starts at the latest first observation, so one small
    aggregate per scope decides; the panel itself is never regrouped by date.
    """
    scope = list(scope)
    keys = [*scope, "symbol"]
    first = panel.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("ts").alias("first_ts"))
    if scope:
        begin = first.groupBy(*scope).agg(F.max("first_ts").alias("begin_ts"))
        live = first.join(begin, scope).select(*keys, "begin_ts")
    else:
        begin = first.agg(F.max("first_ts").alias("begin_ts"))
        live = first.select(*keys, begin.scalar().alias("begin_ts"))
    filled = panel.withColumn(value, ffill(value, keys))
    return filled.join(live, keys).filter("ts >= begin_ts").drop("begin_ts")


def align_volume(
    panel: DataFrame,
    adv: float | dict | DataFrame | str | None,
    default,
    keys: Keys = ("symbol",),
) -> DataFrame:
    """Add ``adv``: a scalar, a per-symbol mapping, daily values or the default.

    Daily values are a table ``(symbol, ts, adv)`` or the name of a panel column; they are filled
    forward, then backward, then with the default.
    """
    fallback = default if isinstance(default, Column) else F.lit(default).cast("double")
    if adv is None:
        return panel.withColumn("adv", fallback)
    if isinstance(adv, (int, float)):
        return panel.withColumn("adv", F.lit(float(adv)))
    if isinstance(adv, dict):
        known = [x for s, v in adv.items() for x in (F.lit(s), F.lit(float(v)))]
        looked_up = F.element_at(F.create_map(*known), F.col("symbol")) if known else F.lit(None)
        return panel.withColumn("adv", F.coalesce(looked_up, fallback))
    if isinstance(adv, str):
        out = panel.withColumn("adv", F.col(adv).cast("double"))
    else:
        daily = adv.select("symbol", "ts", F.col("adv").cast("double").alias("adv"))
        out = panel.drop("adv").join(daily, ["symbol", "ts"], "left")
    # After the forward fill only the start of a series is open: its next value is its first one.
    return out.withColumn("adv", F.coalesce(ffill("adv", keys), first_known("adv", keys), fallback))


def to_wide(panel: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """One column per symbol; the caller names the symbols, so no extra pass finds them."""
    return panel.groupBy("ts").pivot("symbol", symbols).agg(F.first(value))


def to_long(wide: DataFrame, value: str = "close") -> DataFrame:
    symbols = [c for c in wide.columns if c != "ts"]
    return wide.unpivot("ts", symbols, "symbol", value).select("symbol", "ts", value)
