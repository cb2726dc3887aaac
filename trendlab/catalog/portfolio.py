"""Sizing, execution, ledger, attribution and metrics of one run over the type panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import build
from ..functions import costs, scaling
from ..operators import attribution, execution, ledger, metrics, sizing
from ..plans.backtest import replay_differences
from ..plans.scenarios import scenario_list, settings_of, typed_row
from ..sources import sinks
from . import panel
from .registry import register
from .runs_sql import WALK, backtest_sql, runs_cte

# The run of these queries; its date range covers the whole panel.
CONFIG = {
    "signals": {"momentum": {"lookbacks": [63, 126, 252], "skip_last_n": 20}},
    "risk": {
        "vol_model": "ewma", "vol_lookback": 63, "min_vol_periods": 20, "ewma_lambda": 0.94, "target_portfolio_vol": 0.15,
        "gross_exposure_limit": 1.5, "rebalance_threshold": 2.5, "risk_allocator": "proportional",
        "max_instrument_vol_weight": 0.5, "sector_caps": {"Core": 0.4, "Promo": 0.2, "Size": 0.5},
    },
    "execution": {
        "adv_limit_pct": 0.2, "commission_per_contract": 2.5, "impact": {"k": 0.05, "alpha": 0.5},
        "min_slippage_ticks": 0.01, "tick_value": 10.0,
    },
    "backtest": {"start": "1990-01-01", "end": "2039-12-31", "starting_nav": 1_000_000.0, "seed": 42},
}
RUNS = [runs_cte([typed_row(s) for s in scenario_list(CONFIG)])]


def market(spark, sf):
    """Aligned prices with daily volume (column ``adv``), written once, and the universe."""
    return panel.stored_panel(spark, sf), panel.universe(spark)


def base_run(spark, sf, config=CONFIG, **overrides):
    prices, universe = market(spark, sf)
    return build(spark, config, prices, universe, scenario_list(settings_of(config, overrides)))


def sql(final: str, upto: str, *more: str) -> str:
    return backtest_sql(final, upto, RUNS, *more)


# Sizing ---------------------------------------------------------------------------------------

_KEYS = ("run_id", "symbol")


@register("g1_risk_budget", "symbol s, ts d, budget 8", sql("select symbol, ts, budget from budgets", "sized"))
def g1(spark, sf):
    return sizing.risk_budget(base_run(spark, sf).panel, "proportional", _KEYS)


@register(
    "g2_equal_active", "symbol s, ts d, budget 8",
    sql("select symbol, ts, coalesce((signal <> 0)::int / nullif(sum((signal <> 0)::int) over (partition by ts), 0), 0) as budget from base", "panel"),
)
def g2(spark, sf):
    return sizing.risk_budget(base_run(spark, sf).panel, "erc", _KEYS)


@register("g3_sector_caps", "symbol s, ts d, budget 8", sql("select symbol, ts, budget from capped", "sized"))
def g3(spark, sf):
    return sizing.sector_capped(sizing.risk_budget(base_run(spark, sf).panel, keys=_KEYS), keys=_KEYS)


def _weights(spark, sf):
    capped = sizing.sector_capped(sizing.risk_budget(base_run(spark, sf).panel, keys=_KEYS), keys=_KEYS)
    return sizing.vol_target_weight(capped, F.col("target_vol"))


@register("g4_vol_target", "symbol s, ts d, weight 8", sql("select symbol, ts, w0 as weight from weights", "sized"))
def g4(spark, sf):
    return _weights(spark, sf)


@register("g5_position_clip", "symbol s, ts d, weight 8", sql("select symbol, ts, w1 as weight from clipped", "sized"))
def g5(spark, sf):
    return sizing.clip_weight(_weights(spark, sf), F.col("max_weight"))


def _gross(spark, sf):
    clipped = sizing.clip_weight(_weights(spark, sf), F.col("max_weight"))
    return sizing.limit_gross(clipped, F.col("gross_limit"), _KEYS)


@register("g6_gross_limit", "symbol s, ts d, weight 8", sql("select symbol, ts, weight from grossed", "sized"))
def g6(spark, sf):
    return _gross(spark, sf)


@register("g7_contracts", "symbol s, ts d, contracts 8", sql("select symbol, ts, contracts from sized", "sized"))
def g7(spark, sf):
    return sizing.contracts_for(_gross(spark, sf), F.col("starting_nav"))


@register(
    "g8_contract_rounding", "symbol s, ts d, whole 6, half 6, fallback 6",
    panel.sql("""select symbol, ts, round_even(close, 0) as whole, round_even(close / 0.5, 0) * 0.5 as half,
      round_even(coalesce(close, 0), 0) as fallback from gaps where close is not null
      union all select symbol, ts, 0, 0, 0 from gaps where close is null""", by="p_brand"),
)
def g8(spark, sf):
    close = F.col("close")
    return panel.gaps(spark, sf, "p_brand").select(
        "symbol", "ts", scaling.to_contracts(close, 1.0).alias("whole"), scaling.to_contracts(close, 0.5).alias("half"),
        scaling.to_contracts(close, -1.0).alias("fallback"),
    )


_BAND_BRANDS = """wanted as (select symbol, ts, i, coalesce(close, 100) / 4 as contracts from pxi),
held as (
  select symbol, i, case when abs(contracts - 20) < 1.5 then 20.0 else round_even(contracts / 0.5, 0) * 0.5 end as target from wanted where i = 0
  union all
  select n.symbol, n.i, case when abs(n.contracts - h.target) < 1.5 then h.target else round_even(n.contracts / 0.5, 0) * 0.5 end
  from held h join wanted n on n.symbol = h.symbol and n.i = h.i + 1)"""


@register(
    "g9_no_trade_band", "symbol s, ts d, contracts 8, target 6",
    panel.sql("select w.symbol, w.ts, w.contracts, h.target from wanted w join held h using (symbol, i)", _BAND_BRANDS, by="p_brand"),
)
def g9(spark, sf):
    wanted = panel.aligned(spark, sf, "p_brand").select(
        "symbol", "ts", (F.coalesce("close", F.lit(100.0)) / 4).alias("contracts"), F.lit(20.0).alias("opening")
    )
    return sizing.no_trade_band(wanted, 1.5, 0.5, start="opening")


@register("g10_sizing", "run_id s, symbol s, ts d, target 6", sql("select run_id, symbol, ts, target from book", "book"))
def g10(spark, sf):
    return base_run(spark, sf).sized


# Orders and fills -----------------------------------------------------------------------------


@register(
    "h1_hand_off", "symbol s, ts d, desired 6",
    sql("select symbol, ts, lag(target, 1, 0) over (partition by run_id, symbol order by ts) as desired from book", "book"),
)
def h1(spark, sf):
    return execution.hand_off(base_run(spark, sf).sized)


@register(
    "h2_rebalance_orders", "run_id s, order_id i, submitted d, symbol s, qty 6, reason s, target 6",
    sql("select *, 'rebalance' as reason from orders", "orders"),
)
def h2(spark, sf):
    return execution.number_orders(execution.rebalance_orders(base_run(spark, sf).book))


_ROLL_DAYS = "rolls as (select symbol, r.ts from uni cross join (select ts from (select ts, row_number() over (order by ts) as n from (select distinct ts from bars)) where n % 60 = 0) r)"
_ROLL_LEGS = """legs as (
  select run_id, symbol, symbol_pos, ts as submitted, 2 as leg, delta as qty, 'rebalance' as reason, target from deltas where delta <> 0
  union all
  select b.run_id, b.symbol, b.symbol_pos, b.ts, l.leg, case when l.leg = 0 then -b.prev else b.prev end, 'roll', null
  from (select *, lag(target, 1, 0) over (partition by run_id, symbol order by i) as prev, lead(ts) over (partition by run_id, symbol order by i) as nxt from book) b
  join rolls r on r.symbol = b.symbol and r.ts = b.ts cross join (values (0), (1)) l(leg) where abs(b.prev) > 1e-8 and b.nxt is not null),
rolled as (select *, row_number() over (partition by run_id order by submitted, leg = 2, symbol_pos, leg) as order_id from legs)"""
_UNCAPPED = [runs_cte([typed_row(s) for s in scenario_list(settings_of(CONFIG, {"execution": {"adv_limit_pct": 0.0}}))])]


@register(
    "h3_roll_orders", "run_id s, order_id i, submitted d, symbol s, qty 6, reason s, target 6",
    backtest_sql("select * from rolled", "orders", _UNCAPPED, _ROLL_DAYS, _ROLL_LEGS),
)
def h3(spark, sf):
    return _rolling_run(spark, sf, execution={"adv_limit_pct": 0.0}).orders


def _rolling_run(spark, sf, **overrides):
    """The run with every instrument rolling on every 60th date of the panel."""
    run = base_run(spark, sf, **overrides)
    days = run.prices.filter("adv is not null").select("ts").distinct()
    due = days.select("ts", F.row_number().over(Window.orderBy("ts")).alias("n")).filter("n % 60 = 0")
    names = F.array(*[F.lit(s) for s, _, _ in panel.INSTRUMENTS])
    return run.with_rolls(due.select(F.explode(names).alias("symbol"), "ts"))


@register(
    "h3_roll_fills", "run_id s, ts d, symbol s, order_id i, qty 6, reason s, commission 6",
    backtest_sql(
        """select l.run_id, d.ts, l.symbol, l.order_id, l.qty, l.reason, 2.5 * abs(l.qty) as commission from rolled l
        join (select run_id, symbol, ts, lag(ts) over (partition by run_id, symbol order by i) as prev from book) d
          on d.run_id = l.run_id and d.symbol = l.symbol and d.prev = l.submitted""",
        "orders", _UNCAPPED, _ROLL_DAYS, _ROLL_LEGS,
    ),
)
def h3_fills(spark, sf):
    return _rolling_run(spark, sf, execution={"adv_limit_pct": 0.0}).fills


@register(
    "h5_fills_rolls_capped", "run_id s, ts d, symbol s, order_id i, qty 6, reason s, partial b, cost 6",
    backtest_sql("select * from walked_fills", "book", RUNS, _ROLL_DAYS, WALK),
)
def h5_rolls(spark, sf):
    """Rolls under a binding capacity; the SQL walks the sessions one by one."""
    return _rolling_run(spark, sf).fills


@register(
    "h4_capacity", "symbol s, ts d, adv 6, capacity 6",
    sql("select symbol, ts, adv, case when advp > 0 then greatest(advp * adv, 0) end as capacity from base", "panel"),
)
def h4(spark, sf):
    rows = base_run(spark, sf).panel
    return rows.withColumn("capacity", execution.daily_capacity(F.col("adv"), F.col("adv_limit_pct")))


@register(
    "h5_service_curve", "symbol s, ts d, arrived 6, served 6",
    sql("select symbol, ts, arrived, served from curve", "fills"),
)
def h5_curve(spark, sf):
    return execution.service_curve(base_run(spark, sf).book)


@register(
    "h5_fills", "run_id s, ts d, symbol s, submitted d, qty 6, partial b",
    sql("select run_id, ts, symbol, submitted, qty, partial from walked_fills", "book", "rolls as (select symbol, ts from book where false)", WALK),
)
def h5(spark, sf):
    return execution.execute(base_run(spark, sf).book)[1]


@register(
    "h6_commission", "symbol s, ts d, commission 6",
    panel.sql("select symbol, ts, 2.5 * abs(volume - 100) as commission from bars"),
)
def h6(spark, sf):
    qty = F.col("volume") - 100
    return panel.bars(spark, sf).select("symbol", "ts", costs.commission(qty, 2.5).alias("commission"))


@register(
    "h7_participation_slippage", "symbol s, ts d, slippage 6",
    panel.sql("""select symbol, ts, case when q = 0 then 0 else abs(q) * 10.0 * (case when adv <= 0 then greatest(0.02, 0.05)
      else greatest(0.02, 0.05 * pow(least(abs(q) / adv, 1.0), 0.5)) end) end as slippage
      from (select symbol, ts, cast(round(close) as bigint) - 100 as q, volume - 60 as adv from bars)"""),
)
def h7(spark, sf):
    rows = panel.bars(spark, sf).select(
        "symbol", "ts", (F.round("close") - 100).alias("q"), (F.col("volume") - 60).cast("double").alias("adv")
    )
    cost = costs.participation_slippage(F.col("q"), F.col("adv"), k=0.05, alpha=0.5, tick_value=10.0, min_ticks=0.02)
    return rows.withColumn("slippage", cost)


@register(
    "h8_notional_slippage", "symbol s, ts d, slippage 6",
    panel.sql("select symbol, ts, greatest(0.05 * pow(abs(volume * (close - 100)), 0.5), 0.5 * 10.0) as slippage from bars"),
)
def h8(spark, sf):
    notional = F.col("volume") * (F.col("close") - 100)
    return panel.bars(spark, sf).select("symbol", "ts", costs.notional_slippage(notional).alias("slippage"))


@register(
    "h9_trades", "run_id s, ts d, symbol s, qty 6, price 6, notional 6, slippage 6, commission 6, cost 6, reason s, order_id i, partial b",
    sql("select * from costed", "fills"),
)
def h9(spark, sf):
    return base_run(spark, sf).fills


@register("h10_positions", "run_id s, symbol s, ts d, pos 6", sql("select * from positions", "ledger"))
def h10(spark, sf):
    return base_run(spark, sf).positions


@register(
    "h11_cash_after_fill", "run_id s, ts d, symbol s, order_id i, cash_after m3",
    sql("""select run_id, ts, symbol, order_id,
      1000000.0 - sum(notional + cost) over (partition by run_id order by ts, symbol_pos, order_id rows unbounded preceding) as cash_after
      from costed""", "fills"),
)
def h11(spark, sf):
    return base_run(spark, sf).fills


_LEDGER = "run_id s, ts d, nav m3, cash m3, asset_value m3, pnl m3, trading_cost 4, roll_cost 4, total_cost 4"


@register("h12_nav", "run_id s, ts d, nav m3, asset_value m3", sql("select * from ledger", "ledger"))
def h12(spark, sf):
    return base_run(spark, sf).ledger


@register("h12_nav_sparse", "run_id s, ts d, nav m3, asset_value m3", sql("select * from ledger", "ledger"))
def h12_sparse(spark, sf):
    """The same run from the bars as traded: sessions without a bar have no row."""
    bars = panel.stored_bars(spark, sf).select("symbol", "ts", "close", F.col("volume").alias("adv"))
    return build(spark, CONFIG, bars, panel.universe(spark), scenario_list(CONFIG)).ledger


@register("h13_daily_pnl", "run_id s, ts d, pnl m3", sql("select * from ledger", "ledger"))
def h13(spark, sf):
    return base_run(spark, sf).ledger


@register(
    "h14_cost_ledger", "run_id s, ts d, trading_cost 4, roll_cost 4, spent m3",
    sql("select run_id, ts, trading_cost, 0.0 as roll_cost, spent from daycost", "ledger"),
)
def h14(spark, sf):
    return ledger.daily_costs(base_run(spark, sf).raw_fills)


@register("h15_ledger", _LEDGER, sql("select * from ledger", "ledger"))
def h15(spark, sf):
    return base_run(spark, sf).ledger


@register(
    "h16_ledger_identity", "run_id s, sessions i, broken i",
    sql("""select l.run_id, count(*) as sessions, sum((abs(l.nav - l.cash - l.asset_value) > 1e-4
        or abs(l.pnl - (coalesce(c.e, 0) - l.total_cost)) > 1e-4)::int) as broken
      from ledger l left join (select run_id, ts, sum(pnl) as e from contrib group by 1, 2) c using (run_id, ts) group by 1""", "ledger"),
)
def h16(spark, sf):
    run = base_run(spark, sf)
    broken = ledger.identity_violations(run.ledger, run.contributions, 1e-4).select("run_id", F.lit(1).alias("bad"))
    sessions = run.ledger.select("run_id", F.lit(0).alias("bad"))
    return sessions.unionByName(broken).groupBy("run_id").agg(
        F.sum(1 - F.col("bad")).alias("sessions"), F.sum("bad").alias("broken")
    )


# Attribution ----------------------------------------------------------------------------------


@register("i1_contributions", "run_id s, symbol s, ts d, pnl 6", sql("select * from contrib", "ledger"))
def i1(spark, sf):
    return base_run(spark, sf).contributions


@register(
    "i2_sector_contributions", "run_id s, ts d, sector s, pnl 6",
    sql("select run_id, ts, coalesce(nullif(sector, 'Promo'), 'Unknown') as sector, sum(pnl) as pnl from contrib group by 1, 2, 3", "ledger"),
)
def i2(spark, sf):
    known = panel.universe(spark).filter("sector <> 'Promo'")
    return attribution.sector_contributions(base_run(spark, sf).contributions, known)


@register(
    "i3_exposures", "run_id s, symbol s, ts d, exposure 6",
    sql("select run_id, symbol, ts, pos * close * pv as exposure from positions", "ledger"),
)
def i3(spark, sf):
    return base_run(spark, sf).exposures


@register(
    "i4_cost_breakdown", "run_id s, component s, amount m3",
    sql("""select run_id, 'ledger_trading' as component, sum(trading_cost) as amount from ledger group by 1
      union all select run_id, 'ledger_roll', sum(roll_cost) from ledger group by 1
      union all select run_id, 'ledger_total', sum(total_cost) from ledger group by 1
      union all select run_id, 'trades_' || reason, sum(cost) from costed group by 1, 2""", "ledger"),
)
def i4(spark, sf):
    return base_run(spark, sf).roll_costs


@register(
    "i5_top_and_other", "run_id s, place i, symbol s, pnl 6",
    sql("""select run_id, least(r, 4) as place, case when r >= 4 then 'Other' else symbol end as symbol, sum(pnl) as pnl from (
        select *, row_number() over (partition by run_id order by abs(pnl) desc, symbol) as r
        from (select run_id, symbol, sum(pnl) as pnl from contrib group by 1, 2)) group by 1, 2, 3""", "ledger"),
)
def i5(spark, sf):
    totals = base_run(spark, sf).contributions.groupBy("run_id", "symbol").agg(F.sum("pnl").alias("pnl"))
    return attribution.top_and_other(totals, 4)


_NAV_ROWS = """navs as (select symbol as run_id, ts, close as nav from px where close is not null)"""


def _index_navs(spark, sf, by="p_type", stored=False):
    """Instrument indices as NAV series: one run per symbol."""
    source = panel.stored_panel if stored else panel.aligned
    rows = source(spark, sf, by).filter("close is not null")
    return rows.select(F.col("symbol").alias("run_id"), "ts", F.col("close").alias("nav"))


def _from_index(key, column, by="p_brand"):
    from .runs_sql import metrics as metric_cte

    text = panel.sql(f"select run_id, {column} from stats", _NAV_ROWS, metric_cte("navs", "stats"), by=by)

    @register(key, f"run_id s, {column} 7", text)
    def plan(spark, sf):
        return metrics.performance_summary(_index_navs(spark, sf, by)).select("run_id", column)


for _key, _column in (
    ("i6_cagr", "cagr"), ("i8_sharpe", "sharpe"), ("i9_sortino", "sortino"), ("i10_max_drawdown", "max_drawdown"),
    ("i11_calmar", "calmar"), ("i14_hit_rate", "hit_rate"),
):
    _from_index(_key, _column)


@register(
    "i7_annual_return_vol", "run_id s, annual_return 7, volatility 7",
    panel.sql(
        """select run_id, avg(r) * 252 as annual_return, stddev_samp(r) * sqrt(252) as volatility from (
          select run_id, nav / lag(nav) over (partition by run_id order by ts) - 1 as r from navs) group by 1""",
        _NAV_ROWS, by="p_brand",
    ),
)
def i7(spark, sf):
    rets = metrics.nav_returns(_index_navs(spark, sf, "p_brand"))
    return rets.groupBy("run_id").agg(
        metrics.annual_return().alias("annual_return"), metrics.annual_volatility().alias("volatility")
    )


@register(
    "i12_skew_kurtosis", "run_id s, skew 6, kurtosis 6",
    panel.sql(
        """select run_id, skewness(r) as skew, kurtosis(r) as kurtosis from (
          select run_id, nav / lag(nav) over (partition by run_id order by ts) - 1 as r from navs) group by 1""",
        _NAV_ROWS, by="p_brand",
    ),
)
def i12(spark, sf):
    rets = metrics.nav_returns(_index_navs(spark, sf, "p_brand"))
    return rets.groupBy("run_id").agg(metrics.skew().alias("skew"), metrics.kurtosis().alias("kurtosis"))


@register(
    "i13_turnover", "run_id s, turnover 6",
    sql("select run_id, turnover from summary", "summary"),
)
def i13(spark, sf):
    run = base_run(spark, sf)
    return metrics.turnover(run.nav, run.raw_fills)


SUMMARY = ("run_id s, cagr 7, volatility 7, sharpe 6, sortino 6, max_drawdown 7, calmar 6, skew 5, kurtosis 5, turnover 5, hit_rate 7")


@register("i15_summary", SUMMARY, sql("select * from summary", "summary"))
def i15(spark, sf):
    return base_run(spark, sf).summary


@register(
    "i16_rolling_metrics", "run_id s, ts d, rolling_vol 7, rolling_sharpe 5, rolling_sharpe_ann 6",
    panel.sql(
        """select run_id, ts, sd * sqrt(252) as rolling_vol, m * 252 / nullif(sd, 0) as rolling_sharpe,
          m * 252 / nullif(sd, 0) / sqrt(252) as rolling_sharpe_ann from (
            select run_id, ts, avg(r) over w as m, stddev_samp(r) over w as sd, count(r) over w as n from (
              select run_id, ts, nav / lag(nav) over (partition by run_id order by ts) - 1 as r from navs)
            window w as (partition by run_id order by ts rows between 125 preceding and current row)) where n = 126""",
        _NAV_ROWS,
    ),
)
def i16(spark, sf):
    return metrics.rolling_metrics(_index_navs(spark, sf), 126)


@register(
    "i17_drawdowns", "run_id s, ts d, drawdown 8",
    panel.sql("select run_id, ts, nav / max(nav) over (partition by run_id order by ts rows unbounded preceding) - 1 as drawdown from navs", _NAV_ROWS),
)
def i17(spark, sf):
    return metrics.drawdowns(_index_navs(spark, sf))


@register(
    "i18_return_correlation", "run_id s, symbol_a s, symbol_b s, corr 7",
    panel.sql(
        """select 'all' as run_id, a.symbol as symbol_a, b.symbol as symbol_b, corr(a.r, b.r) as corr from full_days a join full_days b using (ts) group by 2, 3""",
        """rr as (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 as r from px),
        full_days as (select * from (select *, count(r) over (partition by ts) as c from rr) where c = (select count(distinct symbol) from px))""",
        by="p_brand",
    ),
)
def i18(spark, sf):
    return attribution.return_correlation(panel.stored_panel(spark, sf, "p_brand").withColumn("run_id", F.lit("all")))


@register(
    "i19_histogram", "run_id s, bin i, bin_start 8, bin_end 8, n i",
    panel.sql(
        """select s.run_id, b.bin, lo + b.bin * (hi - lo) / 50 as bin_start, lo + (b.bin + 1) * (hi - lo) / 50 as bin_end, coalesce(c.n, 0) as n
        from span s cross join (select unnest(range(50)) as bin) b left join (
          select rr.run_id, least(floor((r - lo) / (hi - lo) * 50), 49) as bin, count(*) as n from rr join span using (run_id) group by 1, 2) c
        on c.run_id = s.run_id and c.bin = b.bin""",
        _NAV_ROWS,
        """rr as (select * from (select run_id, nav / lag(nav) over (partition by run_id order by ts) - 1 as r from navs) where r is not null),
        span as (select run_id, min(r) as lo, max(r) as hi from rr group by 1)""",
    ),
)
def i19(spark, sf):
    return metrics.histogram(_index_navs(spark, sf, stored=True))


@register(
    "i20_top_exposures", "run_id s, symbol s, ts d, exposure 6",
    sql("""select run_id, symbol, ts, exposure from expo where symbol in (
      select symbol from expo group by symbol order by avg(abs(exposure)) desc, symbol limit 3)""", "ledger",
      "expo as (select run_id, symbol, ts, pos * close * pv as exposure from positions)"),
)
def i20(spark, sf):
    return attribution.top_exposures(base_run(spark, sf).exposures, 3)


@register(
    "i21_sector_allocation", "run_id s, ts d, sector s, allocation 7",
    sql("select run_id, ts, sector, sum(abs(pos * close * pv / 1000000.0)) as allocation from positions group by 1, 2, 3", "ledger"),
)
def i21(spark, sf):
    return attribution.sector_allocation(base_run(spark, sf).positions, panel.universe(spark), 1_000_000.0)


@register(
    "i22_contract_turnover", "run_id s, ts d, turnover 6, turnover_mean 6",
    sql("""select run_id, ts, turnover, case when count(*) over w = 21 then avg(turnover) over w end as turnover_mean from (
        select run_id, ts, sum(coalesce(d, 0)) as turnover from (
          select run_id, ts, abs(pos - lag(pos) over (partition by run_id, symbol order by ts)) as d from positions) group by 1, 2)
      window w as (partition by run_id order by ts rows between 20 preceding and current row)""", "ledger"),
)
def i22(spark, sf):
    return attribution.contract_turnover(base_run(spark, sf).positions)


@register(
    "i23_cumulative", "run_id s, ts d, cum_trading_cost m3, cum_pnl m3",
    sql("""select run_id, ts, sum(trading_cost) over w as cum_trading_cost, sum(pnl) over w as cum_pnl from ledger
      window w as (partition by run_id order by ts rows unbounded preceding)""", "ledger"),
)
def i23(spark, sf):
    return attribution.cumulative(base_run(spark, sf).ledger, ["trading_cost", "pnl"])


# Stored results -------------------------------------------------------------------------------


@register(
    "a11_summary_json", SUMMARY, sql("select * from summary", "summary"),
)
def a11(spark, sf):
    run = base_run(spark, sf)
    path = sinks.scratch_path(spark, "summary")
    records = sinks.summary_records(run.summary, run.scenarios)
    sinks.write_records(records, path)
    return spark.read.schema(records.schema).json(path)


@register(
    "a12_run_bundle", "artefact s, n i",
    sql("""select 'nav' as artefact, count(*) as n from ledger union all select 'cash', count(*) from ledger
      union all select 'ledger', count(*) from ledger union all select 'positions', count(*) from positions
      union all select 'orders', count(*) from orders union all select 'trades', count(*) from costed
      union all select 'contributions', count(*) from contrib union all select 'exposures', count(*) from positions
      union all select 'sector_contributions', count(*) from (select distinct ts, sector from contrib)
      union all select 'roll_costs', 4 union all select 'rolling_stats', count(*) - 126 from ledger
      union all select 'summary', count(*) from summary""", "summary"),
)
def a12(spark, sf):
    run = base_run(spark, sf)
    path = sinks.scratch_path(spark, "bundle")
    where = sinks.write_bundle(run.tables(), run.summary, run.scenarios.select("run_id", "config_hash"), path, ("parquet",))
    out = None
    for name, location in where.items():
        if name == "scenarios":
            continue
        back = spark.read.json(location) if name == "summary" else spark.read.parquet(f"{location}/parquet")
        part = back.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artefact"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_ARTEFACTS = ("nav", "positions", "trades", "orders", "cash", "ledger")


@register(
    "j17_replay", "artefact s, n_missing i, n_extra i",
    sql("select unnest(['nav', 'positions', 'trades', 'orders', 'cash', 'ledger']) as artefact, 0 * min(i) as n_missing, 0 * min(i) as n_extra from base", "panel"),
)
def j17(spark, sf):
    prices, universe = market(spark, sf)
    first, second = (build(spark, CONFIG, prices, universe, scenario_list(CONFIG)).tables() for _ in range(2))
    return replay_differences({a: first[a] for a in _ARTEFACTS}, {a: second[a] for a in _ARTEFACTS})
