"""Performance statistics of NAV series ``(run_id, ts, nav)``, one row per run and session."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import TRADING_DAYS, pct_change, ratio, rolling, upto

METRICS = (
    "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "skew", "kurtosis", "turnover", "hit_rate",
)
_YEAR = math.sqrt(TRADING_DAYS)


def nav_returns(nav: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Add ``ret``, null on the first session."""
    return nav.withColumn("ret", pct_change("nav", by))


def drawdowns(nav: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Add ``drawdown`` from the running peak."""
    return nav.withColumn("drawdown", ratio(F.col("nav"), F.max("nav").over(upto(by))) - 1)


# Each expression below aggregates rows with ``nav``, ``ret`` and ``drawdown``.


def cagr() -> Column:
    n = F.count("nav")
    growth = ratio(F.max_by("nav", "ts"), F.min_by("nav", "ts"))
    years = F.when(n > 1, (n - 1) / TRADING_DAYS)
    return F.coalesce(F.pow(growth, 1 / years) - 1, F.lit(0.0))


def annual_return() -> Column:
    return F.coalesce(F.avg("ret") * TRADING_DAYS, F.lit(0.0))


def annual_volatility() -> Column:
    return F.when(F.count("ret") == 0, 0.0).otherwise(F.stddev_samp("ret") * _YEAR)


def _over_risk(reward: Column, risk: Column) -> Column:
    return F.when(risk > 0, reward / risk).otherwise(0.0)


def sharpe() -> Column:
    return _over_risk(annual_return(), annual_volatility())


def sortino() -> Column:
    """The downside is the root mean square over losing days only."""
    losses = F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")))
    return _over_risk(annual_return(), F.sqrt(losses) * _YEAR)


def max_drawdown() -> Column:
    return F.coalesce(F.min("drawdown"), F.lit(0.0))


def calmar() -> Column:
    return _over_risk(cagr(), F.abs(max_drawdown()))


def skew() -> Column:
    """Bias-corrected; 0 for constant returns, null below three."""
    n = F.count("ret").cast("double")
    g1 = F.when(F.var_pop("ret") == 0, 0.0).otherwise(F.skewness("ret"))
    return F.when(n == 0, 0.0).when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis() -> Column:
    """Bias-corrected excess kurtosis; 0 for constant returns, null below four."""
    n = F.count("ret").cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ret") + 6)
    value = F.when(F.var_pop("ret") == 0, 0.0).otherwise(corrected)
    return F.when(n == 0, 0.0).when(n > 3, value)


def hit_rate() -> Column:
    return F.coalesce(F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))), F.lit(0.0))


def turnover(nav: DataFrame, trades: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``(by, turnover)``: traded notional over the mean NAV."""
    mean = nav.groupBy(*by).agg(F.avg("nav").alias("_mean"))
    traded = trades.groupBy(*by).agg(F.sum(F.abs("notional")).alias("_traded"))
    both = mean.join(traded, [*by], "left")
    return both.select(*by, F.coalesce(ratio(F.col("_traded"), F.col("_mean")), F.lit(0.0)).alias("turnover"))


def performance_summary(
    nav: DataFrame,
    trades: DataFrame | None = None,
    by: Sequence[str] = ("run_id",),
    runs: DataFrame | None = None,
) -> DataFrame:
    """One row of ten metrics per run; runs listed in ``runs`` without any NAV get zeros."""
    rows = drawdowns(nav_returns(nav, by), by)
    out = rows.groupBy(*by).agg(
        cagr().alias("cagr"),
        annual_volatility().alias("volatility"),
        sharpe().alias("sharpe"),
        sortino().alias("sortino"),
        max_drawdown().alias("max_drawdown"),
        calmar().alias("calmar"),
        skew().alias("skew"),
        kurtosis().alias("kurtosis"),
        hit_rate().alias("hit_rate"),
        F.avg("nav").alias("_mean_nav"),
    )
    if trades is None:
        out = out.withColumn("turnover", F.lit(0.0))
    else:
        traded = trades.groupBy(*by).agg(F.sum(F.abs("notional")).alias("_traded"))
        value = F.coalesce(ratio(F.col("_traded"), F.col("_mean_nav")), F.lit(0.0))
        out = out.join(traded, [*by], "left").withColumn("turnover", value)
    if runs is not None:
        known = out.withColumn("_known", F.lit(True))
        out = runs.select(*by).join(known, [*by], "left")
        out = out.select(*by, *[F.when(F.col("_known"), F.col(m)).otherwise(0.0).alias(m) for m in METRICS])
    return out.select(*by, *METRICS)


def rolling_metrics(nav: DataFrame, window: int = 126, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Trailing volatility and Sharpe of the daily returns.

    ``rolling_sharpe`` divides the annual mean by the *daily* deviation; ``rolling_sharpe_ann`` is
    the same on the usual annual scale.
    """
    rows = nav_returns(nav, by)
    mean, std = rolling(F.avg, "ret", by, window), rolling(F.stddev_samp, "ret", by, window)
    sharpe_daily = ratio(mean * TRADING_DAYS, std)
    return rows.select(
        *by,
        "ts",
        (std * _YEAR).alias("rolling_vol"),
        sharpe_daily.alias("rolling_sharpe"),
        (sharpe_daily / _YEAR).alias("rolling_sharpe_ann"),
    ).filter("rolling_vol is not null or rolling_sharpe is not null")


def histogram(nav: DataFrame, bins: int = 50, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts of daily returns in equal bins from the minimum to the maximum, the last bin closed."""
    by = list(by)
    rets = nav_returns(nav, by).filter("ret is not null").select(*by, "ret")
    span = rets.groupBy(*by).agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.floor((F.col("ret") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        rets.join(span, by)
        .groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


