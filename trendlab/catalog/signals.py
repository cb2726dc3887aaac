"""Signals, returns and volatility over the type panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scaling
from ..functions.series import shift
from ..operators import risk, signals
from ..sources.local import small_table
from . import panel
from .registry import register

_W = "(partition by symbol order by ts)"


def _trail(n: int) -> str:
    return f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"


def _full(agg: str, column: str, n: int) -> str:
    """An aggregate over the last n rows once all n are there."""
    return f"case when count({column}) over {_trail(n)} = {n} then {agg}({column}) over {_trail(n)} end"


def _lagged(raw: str, source: str) -> str:
    return f"""select symbol, ts, coalesce(lag(coalesce(tanh(raw / 3.0), 0)) over {_W}, 0) as signal
      from (select symbol, ts, {raw} as raw from {source})"""


def _momentum_raw(lookbacks, skip) -> str:
    total = sum(lb**-0.5 for lb in lookbacks)
    now = f"lag(close, {skip}) over {_W}"
    terms = [f"coalesce(({now} / lag(close, {skip + lb}) over {_W} - 1) * {lb**-0.5 / total!r}, 0)" for lb in lookbacks]
    return " + ".join(terms)


_MOMENTUM = _lagged(_momentum_raw((63, 126, 252), 20), "px")
_SPREAD = _lagged("(f - s) / (abs(s) + 1e-9)", f"(select symbol, ts, {_full('avg', 'close', 50)} as f, {_full('avg', 'close', 200)} as s from px)")
_CROSS = _lagged("f / (s + 1e-9) - 1", f"(select symbol, ts, {_full('avg', 'close', 50)} as f, {_full('avg', 'close', 200)} as s from px)")
_BREAKOUT = _lagged(
    "(close - (h + l) / 2) / (abs(nullif(h - l, 0)) + 1e-9)",
    f"(select symbol, ts, close, {_full('max', 'close', 100)} as h, {_full('min', 'close', 100)} as l from px)",
)


@register("e1_tsmom", "symbol s, ts d, signal 8", panel.sql(_MOMENTUM))
def e1(spark, sf):
    return signals.momentum(panel.aligned(spark, sf))


@register(
    "e1_tsmom_by_index", "spec i, symbol s, ts d, signal 8",
    panel.sql(
        f"""select 0 as spec, symbol, ts, tanh(raw / 3.0) as signal from (select symbol, ts, {_momentum_raw((21, 63), 5)} as raw from px)
        union all select 1, symbol, ts, tanh(raw / 3.0) from (select symbol, ts, {_momentum_raw((126,), 20)} as raw from px)"""
    ),
)
def e1_by_index(spark, sf):
    horizons = small_table(spark, [(0, 5, 21), (0, 5, 63), (1, 20, 126)], "spec int, skip int, lookback int")
    return signals.momentum_by_index(panel.stored_panel(spark, sf), horizons)


@register("e2_sma_spread", "symbol s, ts d, signal 8", panel.sql(_SPREAD))
def e2(spark, sf):
    return signals.sma_spread(panel.aligned(spark, sf))


@register("e3_sma_crossover", "symbol s, ts d, signal 8", panel.sql(_CROSS))
def e3(spark, sf):
    return signals.sma_crossover(panel.aligned(spark, sf))


@register("e4_breakout", "symbol s, ts d, signal 8", panel.sql(_BREAKOUT))
def e4(spark, sf):
    return signals.channel_breakout(panel.aligned(spark, sf))


@register(
    "e5_zscore", "symbol s, ts d, zscore 6",
    panel.sql(
        f"""select symbol, ts, (close - m) / nullif(s, 0) as zscore from (
          select *, case when count(close) over {_trail(63)} >= 20 then avg(close) over {_trail(63)} end as m,
            case when count(close) over {_trail(63)} >= 20 then stddev_pop(close) over {_trail(63)} end as s from px)"""
    ),
)
def e5(spark, sf):
    return signals.rolling_zscore(panel.aligned(spark, sf), 63, 20)


_RAW = f"(select symbol, ts, 40 * (close / lag(close, 5) over {_W} - 1) as raw from px)"


def _moves(spark, sf):
    return panel.aligned(spark, sf).withColumn("raw", 40 * (F.col("close") / shift("close", 5, ["symbol"]) - 1))


@register("e6_tanh_strength", "symbol s, ts d, strength 8", panel.sql(f"select symbol, ts, tanh(raw / 3.0) as strength from {_RAW}"))
def e6(spark, sf):
    return _moves(spark, sf).withColumn("strength", scaling.tanh_strength(F.col("raw")))


@register(
    "e7_linear_strength", "symbol s, ts d, strength 8",
    panel.sql(f"select symbol, ts, case when raw is not null then greatest(-2.0, least(2.0, raw)) / 2.0 end as strength from {_RAW}"),
)
def e7(spark, sf):
    return _moves(spark, sf).withColumn("strength", scaling.linear_strength(F.col("raw"), 2.0))


@register(
    "e8_guardrails", "symbol s, ts d, tanh_signal 8, linear_signal 8",
    panel.sql(
        f"""select symbol, ts, coalesce(tanh(raw), 0) as tanh_signal,
        coalesce(case when raw is not null then greatest(-3.0, least(3.0, raw)) / 3.0 end, -1) as linear_signal from {_RAW}"""
    ),
)
def e8(spark, sf):
    raw = F.col("raw")
    return _moves(spark, sf).select(
        "symbol", "ts", scaling.guardrail(raw, None).alias("tanh_signal"),
        scaling.guardrail(raw, 3.0, "linear", -1.0).alias("linear_signal"),
    )


@register(
    "e9_signal_lag", "symbol s, ts d, signal 8",
    panel.sql(f"select symbol, ts, coalesce(lag(tanh(raw / 3.0), 3) over {_W}, 0) as signal from {_RAW}"),
)
def e9(spark, sf):
    return signals.lag_signal(_moves(spark, sf).withColumn("signal", scaling.tanh_strength(F.col("raw"))), 3)


@register(
    "e10_blend", "symbol s, ts d, signal 8",
    panel.sql(f"select symbol, ts, avg(signal) as signal from ({_MOMENTUM} union all {_SPREAD} union all {_BREAKOUT}) group by 1, 2"),
)
def e10(spark, sf):
    px = panel.stored_panel(spark, sf)
    return signals.blend([signals.momentum(px), signals.sma_spread(px), signals.channel_breakout(px)])


@register(
    "e10_blend_columns", "symbol s, ts d, signal 8",
    panel.sql(f"select symbol, ts, avg(signal) as signal from ({_MOMENTUM} union all {_SPREAD} union all {_BREAKOUT}) group by 1, 2"),
)
def e10_columns(spark, sf):
    out = signals.momentum(panel.aligned(spark, sf), column="a")
    out = signals.channel_breakout(signals.sma_spread(out, column="b"), column="c")
    return signals.blend_columns(out, ["a", "b", "c"])


@register(
    "latest_signal_ranking", "symbol s, ts d, signal 8, place i",
    panel.sql(
        f"""select symbol, ts, signal, row_number() over (order by signal desc, symbol) as place
        from ({_MOMENTUM}) where ts = (select max(ts) from sess)"""
    ),
)
def latest(spark, sf):
    """Instruments ranked by their signal on the last session."""
    scored = signals.momentum(panel.aligned(spark, sf))
    last = scored.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("signal", "ts").alias("signal"))
    return last.withColumn("place", F.row_number().over(Window.orderBy(F.col("signal").desc(), "symbol")))


# Returns and volatility -----------------------------------------------------------------------

_RETS = f"(select symbol, ts, close / lag(close) over {_W} - 1 as ret, coalesce(close / lag(close) over {_W} - 1, 0) as r0, i from pxi)"
_YEAR = "sqrt(252)"


@register(
    "f1_returns", "symbol s, ts d, ret 10, ret_filled 10",
    panel.sql(f"select symbol, ts, ret, r0 as ret_filled from {_RETS}"),
)
def f1(spark, sf):
    rows = risk.simple_returns(panel.aligned(spark, sf))
    return rows.withColumn("ret_filled", F.coalesce("ret", F.lit(0.0)))


_EWMA = f"""ew as (
  select symbol, ts, i, r0,
    pow(0.94, i) * sum(case when i = 0 then r0 else 0.06 * r0 * pow(0.94, -i) end) over w as m1,
    pow(0.94, i) * sum(case when i = 0 then r0*r0 else 0.06 * r0*r0 * pow(0.94, -i) end) over w as m2,
    pow(0.94, 2*i) + 0.06*0.06 * (1 - pow(0.94, 2*i)) / (1 - 0.94*0.94) as s
  from {_RETS} window w as (partition by symbol order by ts rows unbounded preceding)),
ewvol as (select symbol, ts, i, case when i + 1 >= 20 and s < 1 then sqrt(greatest(m2 - m1*m1, 0) / (1 - s)) * {_YEAR} else 0 end as vol from ew)"""


# The recursion itself, day by day; the closed form above serves the queries that build on it.
_EWMA_STEPS = f"""r0s as materialized (select symbol, ts, i, r0 from {_RETS}),
walk as (
  select symbol, ts, i, r0 as m1, r0 * r0 as m2, 1.0::double as s from r0s where i = 0
  union all
  select n.symbol, n.ts, n.i, 0.94 * w.m1 + 0.06 * n.r0, 0.94 * w.m2 + 0.06 * n.r0 * n.r0, 0.94 * 0.94 * w.s + 0.06 * 0.06
  from walk w join r0s n on n.symbol = w.symbol and n.i = w.i + 1)"""


@register(
    "f2_ewma_vol", "symbol s, ts d, vol 8",
    panel.sql(
        f"select symbol, ts, case when i + 1 >= 20 and s < 1 then sqrt(greatest(m2 - m1*m1, 0) / (1 - s)) * {_YEAR} else 0 end as vol from walk",
        _EWMA_STEPS,
    ),
)
def f2(spark, sf):
    return risk.ewma_volatility(risk.simple_returns(panel.aligned(spark, sf), fill_first=True))


@register(
    "f3_rolling_vol", "symbol s, ts d, vol 8",
    panel.sql(
        f"""select symbol, ts, coalesce(case when count(ret) over {_trail(63)} >= 30 then stddev_pop(ret) over {_trail(63)} end * {_YEAR}, 0) as vol
        from {_RETS}"""
    ),
)
def f3(spark, sf):
    return risk.rolling_volatility(risk.simple_returns(panel.aligned(spark, sf)), 63, 30)


@register(
    "f4_atr", "symbol s, ts d, atr 6",
    panel.sql(
        f"""select symbol, ts, coalesce({_full('avg', 'tr', 14)}, 0) as atr from (
          select symbol, ts, greatest(abs(high - low), abs(high - p), abs(low - p)) as tr
          from (select *, lag(close) over {_W} as p from bars))"""
    ),
)
def f4(spark, sf):
    return risk.average_true_range(panel.bars(spark, sf), 14)


@register(
    "f5_annualize", "symbol s, daily 10, annual 8, back 10",
    panel.sql(
        f"""select symbol, stddev_samp(ret) as daily, stddev_samp(ret) * {_YEAR} as annual, stddev_samp(ret) * {_YEAR} / {_YEAR} as back
        from {_RETS} group by symbol"""
    ),
)
def f5(spark, sf):
    daily = risk.simple_returns(panel.aligned(spark, sf)).groupBy("symbol").agg(F.stddev_samp("ret").alias("daily"))
    rows = daily.withColumn("annual", scaling.annualize(F.col("daily")))
    return rows.withColumn("back", scaling.deannualize(F.col("annual")))


@register(
    "f6_backfilled_vol", "symbol s, ts d, vol 10",
    panel.sql(
        f"""select symbol, ts, coalesce(v, first_value(v ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following)) as vol
        from (select symbol, ts, {_full('stddev_samp', 'ret', 63)} as v from {_RETS})"""
    ),
)
def f6(spark, sf):
    return risk.backfilled_volatility(risk.simple_returns(panel.aligned(spark, sf)))


@register(
    "f7_clean_vol", "model s, symbol s, ts d, vol 8",
    panel.sql(
        f"""select model, symbol, ts, coalesce(
          last_value(v ignore nulls) over (partition by model, symbol order by ts rows unbounded preceding),
          first_value(v ignore nulls) over (partition by model, symbol order by ts rows between current row and unbounded following), 0) as vol
        from (select 'ewma' as model, symbol, ts, nullif(vol, 0) as v from ewvol union all
          select 'rolling', symbol, ts, nullif(case when count(r0) over {_trail(40)} >= 20 then stddev_pop(r0) over {_trail(40)} end * {_YEAR}, 0) from {_RETS})""",
        _EWMA,
    ),
)
def f7(spark, sf):
    px = panel.stored_panel(spark, sf)
    ewma = risk.volatility(px).withColumn("model", F.lit("ewma"))
    rolled = risk.volatility(px, "rolling", lookback=40).withColumn("model", F.lit("rolling"))
    return ewma.unionByName(rolled)
