"""Parameter sweeps, walk-forward, sensitivity curves and bootstrap over the type panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import build, run_parameter_sweep, run_walk_forward
from ..operators.risk import simple_returns
from ..plans import bootstrap, scenarios, sensitivity, walkforward
from ..plans.backtest import Backtest, replay_differences
from ..plans.replay import digests
from ..plans.scenario_table import scenario_table
from . import panel
from .portfolio import CONFIG, market
from .registry import register
from .runs_sql import backtest_sql, runs_cte, runs_per_fold
from .runs_sql import metrics as metrics_sql

GRID = {"signals.momentum.lookbacks": [[63, 126, 252], [63, 252]], "risk.target_portfolio_vol": [0.12, 0.18]}
INSAMPLE, OOS = 756, 252


def _grid_runs(grid: Mapping[str, Sequence] | None = None, **kwargs) -> list[str]:
    return [runs_cte([scenarios.typed_row(s) for s in scenarios.scenario_list(CONFIG, grid, **kwargs)])]


def _sweep(spark, sf, grid=GRID, **kwargs):
    prices, universe = market(spark, sf)
    return run_parameter_sweep(spark, CONFIG, prices, universe, parameter_grid=grid, **kwargs)


# Scenario tables ------------------------------------------------------------------------------


@register(
    "j1_grid_expansion", "symbol s, grid_pos i, lookback i, target_vol 4, usable i",
    panel.sql(
        """select symbol, 3 * l.pos + v.pos as grid_pos, l.lookback, v.target_vol, n - l.lookback as usable
        from (select symbol, count(close) as n from px group by 1)
        cross join (values (0, 21), (1, 63), (2, 126), (3, 252)) l(pos, lookback)
        cross join (values (0, 0.12), (1, 0.15), (2, 0.18)) v(pos, target_vol)""",
        by="p_brand",
    ),
)
def j1(spark, sf):
    series = panel.aligned(spark, sf, "p_brand").groupBy("symbol").agg(F.count("close").alias("n"))
    grid = scenarios.expand_grid_frame(series, {"lookback": [21, 63, 126, 252], "target_vol": [0.12, 0.15, 0.18]})
    return grid.withColumn("usable", F.col("n") - F.col("lookback"))


def folds_cte(insample: int, oos: int, step: int, anchored: bool, name: str = "folds", days: str = "sess") -> str:
    first = "0" if anchored else "s.beg"
    return f"""{name}_days as (select ts, row_number() over (order by ts) - 1 as p from (select distinct ts from {days})),
{name} as (
  select s.fold, a.ts as is_start, b.ts as is_end, c.ts as oos_start, d.ts as oos_end
  from (select row_number() over (order by beg) as fold, beg from (
    select unnest(range(0, greatest((select count(*) from {name}_days) - {insample} - {oos} + 1, 0), {step})) as beg)) s
  join {name}_days a on a.p = {first} join {name}_days b on b.p = s.beg + {insample} - 1
  join {name}_days c on c.p = s.beg + {insample} join {name}_days d on d.p = s.beg + {insample} + {oos} - 1)"""


_FOLD_COLUMNS = "fold i, is_start d, is_end d, oos_start d, oos_end d"


@register(
    "j2_scenarios", f"scenario i, {_FOLD_COLUMNS}, lookback i, target_vol 4, seed i",
    panel.sql(
        """select (fold - 1) * 12 + l.p * 4 + v.p * 2 + s.p + 1 as scenario, folds.*, l.lookback, v.target_vol, s.seed from folds
        cross join (values (0, 63), (1, 126), (2, 252)) l(p, lookback) cross join (values (0, 0.12), (1, 0.18)) v(p, target_vol)
        cross join (values (0, 7), (1, 11)) s(p, seed)""",
        folds_cte(504, 126, 63, True),
    ),
)
def j2(spark, sf):
    return _scenario_table(spark, sf)


def _scenario_table(spark, sf):
    """Folds, then grid, then seeds: the order in which a sweep numbers its runs."""
    folds = walkforward.folds(panel.stored_panel(spark, sf), 504, 126, 63, anchored=True)
    grid = scenarios.expand_grid_frame(folds, {"lookback": [63, 126, 252], "target_vol": [0.12, 0.18], "seed": [7, 11]})
    return grid.withColumn("scenario", (F.col("fold") - 1) * 12 + F.col("grid_pos") + 1)


@register(
    "j2_scenario_settings", "run_id s, fold i, start d, end d, lookback i, n_lookbacks i, target_vol 4, gross_limit 4, core_cap 4, seed i",
    panel.sql(
        """select format('run-{:04d}', (fold - 1) * 12 + l.p * 4 + v.p * 2 + s.p + 1) as run_id, fold, is_start as start, oos_end as end,
          l.lookback, l.n as n_lookbacks, v.target_vol, v.gross_limit, v.core_cap, s.seed from folds
        cross join (values (0, 63, 1), (1, 126, 1), (2, 252, 2)) l(p, lookback, n)
        cross join (values (0, 0.12, 1.5, 0.4), (1, 0.18, null, 0.3)) v(p, target_vol, gross_limit, core_cap)
        cross join (values (0, 7), (1, 11)) s(p, seed)""",
        folds_cte(504, 126, 63, True),
    ),
)
def j2_settings(spark, sf):
    """The settings of every run of a sweep over folds, a grid with whole sections as values, and seeds."""
    folds = walkforward.folds(panel.stored_panel(spark, sf), 504, 126, 63, anchored=True)
    splits = folds.select("fold", F.col("is_start").alias("start"), F.col("oos_end").alias("end"))
    risk = [{"target_portfolio_vol": 0.12}, {"target_portfolio_vol": 0.18, "gross_exposure_limit": None, "sector_caps": {"Core": 0.3}}]
    grid = {"signals.momentum.lookbacks": [[63], [126], [252, 21]], "risk": risk}
    rows = scenario_table(spark, CONFIG, grid, splits=splits, seeds=[7, 11])
    first, caps = F.element_at("lookbacks", 1), F.element_at("sector_caps", "Core")
    return rows.select("*", first.alias("lookback"), F.size("lookbacks").alias("n_lookbacks"), caps.alias("core_cap"))


@register(
    "j4_fingerprint", "n_runs i, n_hashes i, hash_length i",
    panel.sql("select 12 * count(*) as n_runs, 12 * count(*) as n_hashes, 64 as hash_length from folds", folds_cte(504, 126, 63, True)),
)
def j4(spark, sf):
    rows = _scenario_table(spark, sf)
    hashed = rows.withColumn("h", scenarios.fingerprint(rows, exclude=("scenario", "grid_pos")))
    return hashed.agg(
        F.count("h").alias("n_runs"), F.countDistinct("h").alias("n_hashes"), F.max(F.length("h")).alias("hash_length")
    )


# Sweeps ---------------------------------------------------------------------------------------


@register("j3_sweep_nav", "run_id s, ts d, nav m3", backtest_sql("select * from ledger", "ledger", _grid_runs(GRID)))
def j3(spark, sf):
    return _sweep(spark, sf).backtest.nav


_METRIC_COLUMNS = "cagr 7, volatility 7, sharpe 6, sortino 6, max_drawdown 7, calmar 6, skew 5, kurtosis 5, turnover 5, hit_rate 7"


@register(
    "j9_sweep_ranking", f"run_id s, rank i, {_METRIC_COLUMNS}",
    backtest_sql("select *, row_number() over (order by sharpe desc nulls last, run_id) as rank from summary", "summary", _grid_runs(GRID)),
)
def j9(spark, sf):
    return _sweep(spark, sf).ranking()


NINE = {
    "signals.momentum.lookbacks": [[63, 126, 252], [63, 252], [126, 252]],
    "risk.target_portfolio_vol": [0.12, 0.15, 0.18],
}


@register(
    "j9_sweep_nine", f"run_id s, rank i, {_METRIC_COLUMNS}",
    backtest_sql("select *, row_number() over (order by sharpe desc nulls last, run_id) as rank from summary", "summary", _grid_runs(NINE)),
)
def j9_nine(spark, sf):
    return _sweep(spark, sf, NINE).ranking()


#: 40 signal settings times 5 volatility settings: 200 runs, each with features of its own.
_TWO_HUNDRED = {
    "signals.momentum.lookbacks": [[20 + 4 * k, 252] for k in range(40)],
    "risk.ewma_lambda": [0.9, 0.92, 0.94, 0.96, 0.98],
}


@register(
    "j3_sweep_two_hundred", f"run_id s, rank i, {_METRIC_COLUMNS}",
    backtest_sql("select *, row_number() over (order by sharpe desc nulls last, run_id) as rank from summary", "summary", _grid_runs(_TWO_HUNDRED)),
)
def j3_two_hundred(spark, sf):
    return _sweep(spark, sf, _TWO_HUNDRED).ranking()


@register(
    "j17_replay_sweep", "artefact s, n_rows i, n_missing i, n_extra i",
    backtest_sql(
        """select 'nav' as artefact, count(*) as n_rows, 0 as n_missing, 0 as n_extra from ledger
        union all select 'trades', count(*), 0, 0 from costed""",
        "ledger", _grid_runs(GRID),
    ),
)
def j17_sweep(spark, sf):
    """Every run of a sweep computed twice: rows, and how many of them differ."""
    first, second = (_sweep(spark, sf).backtest.tables() for _ in range(2))
    names = ("nav", "trades")
    found = replay_differences({n: first[n] for n in names}, {n: second[n] for n in names})
    rows = reduce(DataFrame.unionByName, (first[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("artefact"), "n_rows") for n in names))
    return rows.join(found, "artefact")


@register(
    "j17_replay_digests", "run_id s, artefact s, n_rows i, n_digests i, hash_length i",
    backtest_sql(
        """select run_id, artefact, count(*) as n_rows, 1 as n_digests, 64 as hash_length from (
          select run_id, unnest(['nav', 'ledger']) as artefact from ledger union all select run_id, 'trades' from costed
          union all select run_id, 'positions' from positions) group by 1, 2""",
        "ledger", _grid_runs(GRID),
    ),
)
def j17_digests(spark, sf):
    """Every run of a sweep computed twice: rows and distinct digests of its tables."""
    names = ("nav", "ledger", "trades", "positions")
    both = (digests({n: tables[n] for n in names}, ["run_id"]) for tables in (_sweep(spark, sf).backtest.tables() for _ in range(2)))
    return reduce(DataFrame.unionByName, both).groupBy("run_id", "artefact").agg(
        F.max("n_rows").alias("n_rows"), F.countDistinct("digest").alias("n_digests"), F.max(F.length("digest")).alias("hash_length")
    )


_MODELS = {"risk.vol_model": ["ewma", "rolling"], "risk.risk_allocator": ["proportional", "erc"], "risk.ewma_lambda": [0.9, 0.97]}


@register(
    "j9_sweep_risk_models", f"run_id s, {_METRIC_COLUMNS}",
    backtest_sql("select * from summary", "summary", _grid_runs(_MODELS)),
)
def j9_models(spark, sf):
    return _sweep(spark, sf, _MODELS).backtest.summary


_OVERRIDES = ", ".join(
    f"""('run-{k:04d}', '{{"risk": {{"target_portfolio_vol": {v}}}, "signals": {{"momentum": {{"lookbacks": {lb}}}}}}}')"""
    for k, (lb, v) in enumerate(((lb, v) for lb in GRID["signals.momentum.lookbacks"] for v in GRID["risk.target_portfolio_vol"]), start=1)
)


@register(
    "j18_scenario_metadata", "run_id s, grid_overrides s, seed i, hash_length i, sharpe 6, rank i",
    backtest_sql(
        f"""select s.run_id, t.grid_overrides, 11 as seed, 64 as hash_length, s.sharpe,
          row_number() over (order by s.sharpe desc nulls last, s.run_id) as rank
        from summary s join (values {_OVERRIDES}) t(run_id, grid_overrides) using (run_id)""",
        "summary", _grid_runs(GRID, seeds=[11]),
    ),
)
def j18(spark, sf):
    """Each run's settings beside the result they led to."""
    sweep = _sweep(spark, sf, seeds=[11])
    ranks = sweep.ranking().select("run_id", "sharpe", "rank")
    return sweep.metadata.join(ranks, "run_id").withColumn("hash_length", F.length("config_hash"))


def _curve_sql(values, label: str, runs: list[str]) -> str:
    names = ", ".join(f"('run-{i:04d}', {v!r})" for i, v in enumerate(values, start=1))
    return backtest_sql(
        f"select n.{label}, s.sharpe from stats s join (values {names}) n(run_id, {label}) using (run_id)", "ledger", runs,
        metrics_sql("ledger", "stats"),
    )


def _template(spark, sf) -> Backtest:
    prices, universe = market(spark, sf)
    return build(spark, CONFIG, prices, universe, scenarios.scenario_list(CONFIG))


_LIMITS, _LOOKBACKS, _TARGETS = (0.5, 1.0, 2.0), (42, 126, 252), (0.1, 0.15, 0.2)


@register(
    "j10_sensitivity", "gross 4, sharpe 6",
    _curve_sql(_LIMITS, "gross", _grid_runs({"risk.gross_exposure_limit": _LIMITS})),
)
def j10(spark, sf):
    return sensitivity.metric_sensitivity(_template(spark, sf), CONFIG, "risk.gross_exposure_limit", _LIMITS, label="gross")


@register(
    "j11_lookback_sensitivity", "lookback i, sharpe 6",
    _curve_sql(_LOOKBACKS, "lookback", _grid_runs({"signals.momentum.lookbacks": [[lb] for lb in _LOOKBACKS]})),
)
def j11(spark, sf):
    return sensitivity.lookback_sensitivity(_template(spark, sf), CONFIG, _LOOKBACKS)


@register(
    "j12_vol_target_sensitivity", "vol_target 4, sharpe 6",
    _curve_sql(_TARGETS, "vol_target", _grid_runs({"risk.target_portfolio_vol": _TARGETS})),
)
def j12(spark, sf):
    return sensitivity.vol_target_sensitivity(_template(spark, sf), CONFIG, _TARGETS)


# Walk-forward ---------------------------------------------------------------------------------


@register(
    "j5_folds", f"kind s, {_FOLD_COLUMNS}",
    panel.sql("select 'anchored' as kind, * from a union all select 'rolling', * from r", folds_cte(504, 126, 126, True, "a"),
              folds_cte(252, 63, 40, False, "r")),
)
def j5(spark, sf):
    px = panel.stored_panel(spark, sf)
    anchored = walkforward.folds(px, 504, 126).withColumn("kind", F.lit("anchored"))
    return anchored.unionByName(walkforward.folds(px, 252, 63, 40, anchored=False).withColumn("kind", F.lit("rolling")))


@register(
    "j6_fold_split", "fold i, symbol s, ts d, close 6",
    panel.sql("select fold, symbol, ts, close from px join folds on ts between is_start and oos_end", folds_cte(504, 126, 126, False)),
)
def j6(spark, sf):
    px = panel.stored_panel(spark, sf)
    return walkforward.split_by_fold(px, walkforward.folds(px, 504, 126, anchored=False))


_ONE = scenarios.typed_row(scenarios.scenario_list(CONFIG)[0])
_WF_RUNS = [folds_cte(INSAMPLE, OOS, OOS, True), *runs_per_fold(_ONE)]
_PHASES = """phased as (
  select l.run_id, r.fold, case when l.ts between f.is_start and f.is_end then 'IS' else 'OOS' end as phase, l.ts, l.nav
  from ledger l join runs r using (run_id) join folds f on f.fold = r.fold where l.ts <= f.oos_end)"""


def _walk(spark, sf):
    prices, universe = market(spark, sf)
    return run_walk_forward(spark, CONFIG, prices, universe, insample=INSAMPLE, oos=OOS)


@register(
    "j7_phase_summaries", f"run_id s, fold i, phase s, {_METRIC_COLUMNS.replace('turnover 5, ', '')}",
    backtest_sql("select * from phase_stats", "ledger", _WF_RUNS, _PHASES, metrics_sql("phased", "phase_stats", "run_id, fold, phase")),
)
def j7(spark, sf):
    walk = _walk(spark, sf)
    return walkforward.phase_summaries(walk.nav, walk.folds)


@register(
    "j8_walk_forward", f"{_FOLD_COLUMNS}, is_sharpe 6, oos_sharpe 6, is_cagr 7, oos_cagr 7, oos_max_drawdown 7, sharpe 6, turnover 5",
    backtest_sql(
        """select f.*, i.sharpe as is_sharpe, o.sharpe as oos_sharpe, i.cagr as is_cagr, o.cagr as oos_cagr,
          o.max_drawdown as oos_max_drawdown, s.sharpe, s.turnover
        from folds f join phase_stats i on i.fold = f.fold and i.phase = 'IS' join phase_stats o on o.fold = f.fold and o.phase = 'OOS'
        join summary s on s.run_id = i.run_id""",
        "summary", _WF_RUNS, _PHASES, metrics_sql("phased", "phase_stats", "run_id, fold, phase"),
    ),
)
def j8(spark, sf):
    return _walk(spark, sf).summary


# Bootstrap ------------------------------------------------------------------------------------

SAMPLES, BLOCK, SEED = 100, 20, 7


def _lattice(sample, block, choices):
    """The generator the SQL can repeat (regular, so never the default)."""
    return F.pmod(sample * 7919 + block * 104729 + SEED, choices)


def _returns(spark, sf):
    rows = simple_returns(panel.aligned(spark, sf)).withColumnRenamed("symbol", "run_id")
    return bootstrap.indexed_returns(rows)


def _sampled(samples: int = SAMPLES, start: str = f"s.sample * 7919 + k.block * 104729 + {SEED}") -> str:
    return f"""rets as (
  select symbol as run_id, ret, row_number() over (partition by symbol order by ts) - 1 as idx
  from (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 as ret from px) where ret is not null),
sizes as (select run_id, count(*) as n, least({BLOCK}, count(*)) as b from rets group by 1),
draws as (
  select z.run_id, z.n, z.b, s.sample, k.block, ({start}) % (z.n - z.b + 1) as start
  from sizes z cross join (select unnest(range({samples})) as sample) s cross join lateral (select unnest(range(0, cast(ceil(z.n / z.b) as bigint))) as block) k),
picks as (
  select d.run_id, d.sample, d.block * d.b + o.off as pos, d.start + o.off as idx
  from draws d cross join (select unnest(range({BLOCK})) as off) o where o.off < d.b and d.block * d.b + o.off < d.n),
samples as (select p.run_id, p.sample, p.pos, r.ret from picks p join rets r on r.run_id = p.run_id and r.idx = p.idx)"""


_SAMPLED = _sampled()


@register(
    "j13_bootstrap_samples", "run_id s, sample i, n i, total 8, weighted 5",
    panel.sql("select run_id, sample, count(*) as n, sum(ret) as total, sum(ret * pos) as weighted from samples group by 1, 2", _SAMPLED),
)
def j13(spark, sf):
    rows = bootstrap.sample_rows(bootstrap.block_samples(_returns(spark, sf), BLOCK, SAMPLES, SEED, _lattice))
    return rows.groupBy("run_id", "sample").agg(
        F.count("ret").alias("n"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("pos")).alias("weighted")
    )


_STATS = """sharpes as (select run_id, sample, coalesce(avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0), 0) as value from samples group by 1, 2),
paths as (
  select run_id, sample, pos, exp(sum(ln(1 + ret)) over (partition by run_id, sample order by pos rows unbounded preceding)) as nav from samples),
falls as (
  select run_id, sample, min(nav / peak - 1) as value from (
    select *, max(nav) over (partition by run_id, sample order by pos rows unbounded preceding) as peak from paths) group by 1, 2)"""


@register("j14_sample_sharpe", "run_id s, sample i, sharpe 7", panel.sql("select run_id, sample, value as sharpe from sharpes", _SAMPLED, _STATS))
def j14(spark, sf):
    return bootstrap.block_stats(_returns(spark, sf), ("sharpe",), BLOCK, SAMPLES, SEED, _lattice)


@register(
    "j15_sample_drawdown", "run_id s, sample i, max_drawdown 7",
    panel.sql("select run_id, sample, value as max_drawdown from falls", _SAMPLED, _STATS),
)
def j15(spark, sf):
    return bootstrap.block_stats(_returns(spark, sf), ("max_drawdown",), BLOCK, SAMPLES, SEED, _lattice)


_INTERVAL = "run_id s, metric s, mean 7, lower 7, upper 7"


_INTERVALS = """select run_id, metric, avg(value) as mean, quantile_cont(value, 0.025) as lower, quantile_cont(value, 0.975) as upper
  from (select 'sharpe' as metric, * from sharpes union all select 'max_drawdown', * from falls) group by 1, 2"""


@register("j16_bootstrap_interval", _INTERVAL, panel.sql(_INTERVALS, _SAMPLED, _STATS))
def j16(spark, sf):
    return bootstrap.confidence_intervals(_returns(spark, sf), n_samples=SAMPLES, block_size=BLOCK, start_of=_lattice)


_HASHED = f"cast('0x' || substr(md5('{SEED}|' || s.sample || '|' || k.block), 1, 8) as bigint)"


@register("j16_bootstrap_default", _INTERVAL, panel.sql(_INTERVALS, _sampled(1000, _HASHED), _STATS))
def j16_default(spark, sf):
    """The default generator with the default 1,000 samples."""
    return bootstrap.confidence_intervals(_returns(spark, sf), seed=SEED)
