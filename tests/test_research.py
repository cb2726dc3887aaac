"""Runs, sweeps, walk-forward and bootstrap end to end."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import trendlab
from trendlab import api
from trendlab.plans import bootstrap, replay, scenario_table, scenarios, sensitivity, walkforward
from trendlab.plans.backtest import replay_differences
from trendlab.sources.universe import load_universe

CONFIG = {
    "signals": {"momentum": {"lookbacks": [7], "skip_last_n": 1}},
    "risk": {"target_portfolio_vol": 0.17, "max_instrument_vol_weight": 0.6, "min_vol_periods": 6, "rebalance_threshold": 0.0},
    "execution": {"adv_limit_pct": 0.8, "adv_contracts": {"ES": 700, "CL": 4}, "commission_per_contract": 1.5},
    "backtest": {"start": "2020-01-01", "end": "2020-12-31", "starting_nav": 2_500_000.0},
}


@pytest.fixture(scope="module")
def market(spark, weekdays, long_prices):
    rng = random.Random(5)
    days = weekdays("2020-01-01", 60)
    walk = {}
    for s in ("ES", "CL"):
        value, out = 100.0, []
        for _ in days:
            value *= math.exp(rng.gauss(0.001, 0.01))
            out.append(value)
        walk[s] = out
    universe = load_universe(
        spark, [{"symbol": "ES", "sector": "Equities", "point_value": 50}, {"symbol": "CL", "sector": "Energy", "point_value": 100}]
    )
    return long_prices(days, walk).cache(), universe, days


def test_run_and_replay(spark, market):
    prices, universe, days = market
    run = trendlab.run_backtest(spark, CONFIG, prices, universe, check_reproducibility=True)
    rows = run.ledger.orderBy("ts").collect()
    assert [r.ts for r in rows] == days and rows[0].nav == 2_500_000
    assert run.fills.count() > 0 and run.summary.first().turnover > 0
    tables = {"nav": run.nav}
    altered = {"nav": run.nav.withColumn("nav", F.col("nav") + 1)}
    with pytest.raises(RuntimeError):
        api.assert_reproducible(tables, altered)
    assert replay_differences(tables, altered).first().n_missing == 60


def test_replay_tolerates_last_bits_only(spark, market):
    prices, universe, _ = market
    config = scenarios.settings_of(CONFIG, {"backtest.check_reproducibility": True})
    sweep = api.run_parameter_sweep(spark, config, prices, universe, parameter_grid={"risk.target_portfolio_vol": [0.1, 0.3]})
    nav = sweep.backtest.nav
    near, far = nav.withColumn("nav", F.col("nav") * (1 + 1e-13)), nav.withColumn("nav", F.col("nav") * (1 + 1e-6))
    count = lambda other: tuple(replay_differences({"nav": nav}, {"nav": other}).first())[1:]
    assert (count(near), count(far), count(nav.limit(100))) == ((0, 0), (120, 120), (20, 0))
    assert count(nav.unionByName(nav.limit(3)))[1] == 3


def test_digests_are_of_the_multiset_of_rows(spark):
    schema = "k string, v double, n int, m map<string,int>"
    rows = [("a", 1.5, 1, {"x": 1, "y": 2}), ("a", 1.5, 1, {"y": 2, "x": 1}), ("b", None, 2, None), (None, 0.0, None, {}), ("b", -2.25, 2, {"x": None})]
    digest = lambda r, s=schema: tuple(replay.table_digest(spark.createDataFrame(r, s).repartition(3)).first())
    same = digest(rows)
    assert same[0] == 5 and digest(rows[::-1]) == same
    assert digest([rows[0], rows[1], rows[2], (None, -0.0, None, {}), rows[4]]) == same
    turned = spark.createDataFrame(rows, schema).select("m", "n", "k", "v")
    assert tuple(replay.table_digest(turned).first()) == same
    moved = [("a", 1.5000000000000002, 1, {"x": 1, "y": 2}), *rows[1:]]
    swapped = [("a", 1.5, 1, rows[0][3]), ("b", 1.5, 1, rows[0][3]), ("a", None, 2, None), *rows[3:]]
    others = [rows[:-1], [*rows, rows[0]], [*rows, rows[2]], moved, swapped, [rows[0], rows[1], (None, None, 2, None), *rows[3:]], []]
    assert len({digest(r) for r in others} | {same}) == len(others) + 1
    by_key = {r.k: r.n_rows for r in replay.table_digest(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert by_key == {"a": 2, "b": 2, None: 1}


def test_a_run_computed_twice_has_the_same_digests(spark, market):
    """Also when its rows come in other partitions and another order."""
    prices, universe, _ = market
    first = trendlab.run_backtest(spark, CONFIG, prices, universe).tables()
    mixed = prices.repartition(7, "ts").orderBy(F.xxhash64("symbol", "ts"))
    assert replay.changed_tables(first, trendlab.run_backtest(spark, CONFIG, mixed, universe).tables()) == []
    moved = {**first, "nav": first["nav"].withColumn("nav", F.col("nav") + 1e-9)}
    assert replay.changed_tables(first, moved) == ["nav"]
    api.assert_reproducible(first, moved)  # within the tolerance


def test_absent_rows_count_as_missing_values(spark, market):
    prices, universe, days = market
    lost = [d for k, d in enumerate(days) if k % 7 == 3]
    gone = F.col("ts").isin(lost) & (F.col("symbol") == "CL")
    sparse = trendlab.run_backtest(spark, CONFIG, prices.filter(~gone), universe).ledger.orderBy("ts").collect()
    nulls = prices.withColumn("close", F.when(~gone, F.col("close")))
    dense = trendlab.run_backtest(spark, CONFIG, nulls, universe).ledger.orderBy("ts").collect()
    assert [r.ts for r in sparse] == days
    for a, b in zip(sparse, dense, strict=True):
        assert a.nav == pytest.approx(b.nav, abs=1e-6)


def test_duplicate_dates_and_empty_windows_raise(spark, market):
    prices, universe, days = market
    doubled = prices.unionByName(prices.filter(F.col("ts") == F.lit(days[5])).limit(1))
    with pytest.raises(ValueError, match="more than one price"):
        trendlab.run_backtest(spark, CONFIG, doubled, universe)
    with pytest.raises(ValueError, match="no prices between"):
        trendlab.run_backtest(spark, CONFIG, prices, universe, parameter_overrides={"backtest.start": "2020-12-01"})


def test_grid_splits_have_distinct_hashes(spark, market):
    prices, universe, days = market
    grid = {"signals.momentum.lookbacks": [[4], [9]], "risk.target_portfolio_vol": [0.08, 0.21]}
    splits = [{"start": days[0], "end": days[29]}, {"start": days[29], "end": days[-1]}]
    sweep = api.run_parameter_sweep(spark, CONFIG, prices, universe, parameter_grid=grid, splits=splits, seeds=[7])
    assert sweep.metadata.select("config_hash").distinct().count() == 8
    spans = sweep.backtest.nav.groupBy("run_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    assert len(spans) == 8 and {(r.a, r.b) for r in spans} == {(days[0], days[29]), (days[29], days[-1])}


def test_sweep_equals_single_runs(spark, market):
    prices, universe, _ = market
    grid = {"signals.momentum.lookbacks": [[4], [6, 12]], "risk.vol_model": ["ewma", "rolling"]}
    sweep = api.run_parameter_sweep(spark, CONFIG, prices, universe, parameter_grid=grid)
    together = {(r.run_id, r.ts): r.nav for r in sweep.backtest.nav.collect()}
    for scenario in sweep.scenarios[1:3]:
        alone = api.run_backtest(spark, scenario["config"], prices, universe)
        for r in alone.nav.collect():
            assert together[scenario["run_id"], r.ts] == pytest.approx(r.nav, abs=1e-6)


def test_settings_are_rows_in_any_number(spark, market, monkeypatch):
    """Each run of a large sweep equals the run alone, also when its settings are dealt to several join keys."""
    from trendlab.plans import backtest

    prices, universe, _ = market
    grid = {"signals.momentum.lookbacks": [[k] for k in range(2, 12)], "risk.vol_model": ["ewma", "rolling"], "risk.vol_lookback": [5, 6, 9], "risk.min_vol_periods": [2, 3]}
    whole = api.run_parameter_sweep(spark, CONFIG, prices, universe, parameter_grid=grid)
    key = lambda r: (r.run_id, r.symbol, r.ts, r.target)
    rows = sorted(map(key, whole.backtest.sized.collect()))
    assert len({r[0] for r in rows}) == 120
    monkeypatch.setattr(backtest, "SETTINGS_PER_PART", 3)
    parts = api.run_parameter_sweep(spark, CONFIG, prices, universe, parameter_grid=grid).backtest
    assert sorted(map(key, parts.sized.collect())) == rows
    for scenario in (whole.scenarios[3], whole.scenarios[70]):
        alone = api.run_backtest(spark, scenario["config"], prices, universe).sized.collect()
        assert [(r[1], r[2], pytest.approx(r[3])) for r in rows if r[0] == scenario["run_id"]] == sorted((r.symbol, r.ts, r.target) for r in alone)


def test_features_by_setting_equal_the_columns(spark, market):
    """Settings as rows give the values of the one-setting operators."""
    from trendlab.operators import risk, signals

    prices, _, _ = market
    panel = prices.withColumn("window_id", F.lit(0))
    keys = ("window_id", "symbol")
    specs = [(0, 0, [3, 8], 2), (0, 1, [5], 0)]
    table = spark.createDataFrame(specs, "window_id int, sig_id int, lookbacks array<int>, skip int")
    got = {(r.sig_id, r.symbol, r.ts): r.signal for r in signals.momentum_by_setting(panel, table).collect()}
    for _, number, lookbacks, skip in specs:
        for r in signals.momentum(panel, lookbacks, skip, keys=keys).collect():
            assert got[number, r.symbol, r.ts] == pytest.approx(r.signal, abs=1e-12)
    specs = [(0, 0, "ewma", 0.9, 3, 0), (0, 1, "rolling", 0.0, 4, 6), (0, 2, "rolling", 0.0, 9, 9)]
    table = spark.createDataFrame(specs, "window_id int, vol_id int, model string, lam double, min_periods int, lookback int")
    for look in (True, False):
        found = risk.volatility_by_setting(panel, table, ("ewma", "rolling"), allow_lookahead=look)
        got = {(r.vol_id, r.symbol, r.ts): r.vol for r in found.collect()}
        for _, number, model, lam, least, lookback in specs:
            for r in risk.volatility(panel, model, lookback, lam, least, keys, allow_lookahead=look).collect():
                assert got[number, r.symbol, r.ts] == pytest.approx(r.vol, rel=1e-9, abs=1e-12)
    flat = panel.withColumn("close", F.lit(7.0))
    assert {r.vol for r in risk.volatility_by_setting(flat, table, ("ewma", "rolling")).collect()} == {0.0}


def test_layers_of_settings():
    base = {"a": {"x": 0, "y": 9}, "caps": {"K": 0.5}}
    assert scenarios.settings_of(base, {"a.x": 1, "b": 3}, None) == {"a.x": 1, "a.y": 9, "b": 3, "caps.K": 0.5}
    assert scenarios.settings_of(base, {"a": 7}) == {"a": 7, "caps.K": 0.5}
    assert scenarios.settings_of({"a": 7}, {"a": {"x": {"z": 1}}}) == {"a.x.z": 1}
    assert base == {"a": {"x": 0, "y": 9}, "caps": {"K": 0.5}}
    flat = scenarios.settings_of(base, {"caps": {"L.M": 0.25}})
    assert scenarios.setting(flat, "caps") == {"K": 0.5, "L.M": 0.25} and scenarios.setting(flat, "a.z", 4) == 4
    assert scenarios.sections({"a.y": 1, "a.x.z": 2}) == {"a": {"y": 1, "x": {"z": 2}}}


def test_a_scenario_table_equals_the_list(spark):
    grid = {
        "signals.momentum.lookbacks": [[63, 126], [5.0]],
        "risk": [{"vol_model": "rolling", "sector_caps": {"A.B": 0.5}}, {"gross_exposure_limit": None}, {}],
        "risk.target_portfolio_vol": [0.1, 1],
    }
    base, splits = {"execution.impact.k": 0.5}, [{"start": "2020-01-01"}, {"start": dt.date(2020, 2, 3), "end": "2021-01-01"}]
    for request in ((CONFIG, grid, base, splits, [1, 2]), (CONFIG, None, None, None, None), (CONFIG, {"backtest.seed": [3]}, None, [], 9)):
        want = scenarios.scenario_frame(spark, [scenarios.typed_row(s) for s in scenarios.scenario_list(*request)])
        table = scenario_table.scenario_table(spark, *request)
        assert sorted(map(repr, table.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    shown = {r.run_id: r for r in scenario_table.table_metadata(scenario_table.scenario_table(spark, CONFIG, grid, base, splits, [1, 2]), base).collect()}
    assert len(shown) == 48 and shown["run-0008"].seed == 2
    assert shown["run-0008"].grid_overrides == '{"risk": {"gross_exposure_limit": null, "target_portfolio_vol": 1}, "signals": {"momentum": {"lookbacks": [63, 126]}}}'
    assert shown["run-0008"].combined_overrides.startswith('{"execution": {"impact": {"k": 0.5}}, "risk"')


@pytest.mark.parametrize("wrong", [{"signals.momentum.lookbacks": [[5], [0]]}, {"risk.vol_model": ["odd"]}, {"risk.risk_allocator": ["all"]}, {"backtest.end": [None]}])
def test_a_scenario_table_checks_its_rows(spark, wrong):
    with pytest.raises(ValueError, match="run-000"):
        scenario_table.scenario_table(spark, CONFIG, wrong)


def test_many_scenarios_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scenario_table, "ROWS_PER_TASK", 50)
    grid = {"risk.target_portfolio_vol": [k / 1000 for k in range(1, 41)], "risk.ewma_lambda": [k / 100 for k in range(50, 99)]}
    rows = scenario_table.scenario_table(spark, CONFIG, grid, seeds=[1, 2, 3, 4, 5, 6]).collect()
    assert len(rows) == 40 * 49 * 6 and {int(r.run_id[4:]) for r in rows} == set(range(1, len(rows) + 1))
    by_number = {int(r.run_id[4:]) - 1: r for r in rows}
    for n in (0, 5, 6, 293, 294, 11_759):
        point = (n // 294, n // 6 % 49, n % 6)
        assert (by_number[n].target_vol, by_number[n].ewma_lambda, by_number[n].seed) == pytest.approx(((point[0] + 1) / 1000, (point[1] + 50) / 100, point[2] + 1))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_ranks_by_ranges(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1.0, rng.random()])) for i in range(n)]
    table = spark.createDataFrame(rows, "i int, v double").repartition(6)
    got = {r.i: r["rank"] for r in scenario_table.numbered_rows(table, [F.col("v").desc_nulls_last(), F.col("i")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: k for k, (i, _) in enumerate(order, 1)}


def test_scenarios_count_seeds_first_then_grid_then_splits():
    grid = {"risk.target_portfolio_vol": [0.1, 0.2], "risk.vol_lookback": [21, 42]}
    rows = scenarios.scenario_list(CONFIG, grid, splits=[{"start": "2020-01-01"}, {"start": "2020-02-03"}], seeds=[1, 2])
    assert [r["run_id"] for r in rows] == [f"run-{k:04d}" for k in range(1, 17)]
    picked = [(r["fold"], r["config"]["risk.target_portfolio_vol"], r["config"]["risk.vol_lookback"], r["run_seed"]) for r in rows]
    assert picked == [(f, v, lb, s) for f in (1, 2) for v in (0.1, 0.2) for lb in (21, 42) for s in (1, 2)]
    assert rows[9]["config"]["backtest.start"] == "2020-02-03" and rows[9]["config"]["backtest.seed"] == 2
    assert len(scenarios.scenario_list(CONFIG)) == 1


def window_loop(n, insample, oos, step, anchored):
    out, at = [], 0
    while at + insample + oos <= n:
        out.append((0 if anchored else at, at + insample - 1, at + insample, at + insample + oos - 1))
        at += step
    return out


@pytest.mark.parametrize("insample,oos,step,anchored", [(10, 5, None, True), (10, 5, None, False), (15, 7, 3, False), (29, 31, 5, True), (40, 21, 1, True)])
def test_folds_against_loop(spark, market, insample, oos, step, anchored):
    prices, _, days = market
    rows = walkforward.folds(prices, insample, oos, step, anchored).orderBy("fold").collect()
    want = [tuple(days[i] for i in w) for w in window_loop(len(days), insample, oos, step or oos, anchored)]
    assert [(r.is_start, r.is_end, r.oos_start, r.oos_end) for r in rows] == want


@pytest.mark.parametrize("seed", range(3))
def test_rows_in_windows_against_loop(spark, seed):
    """Random windows with equal bounds, single days, ends before starts and null ends; rows repeated and without a date."""
    rng = random.Random(seed)
    day = lambda lo, hi: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(lo, hi))
    windows = [(i, day(0, 60), day(20, 90)) for i in range(25)] + [(30, dt.date(1999, 1, 1), dt.date(2029, 1, 1))]
    windows += [(31, None, day(0, 9)), (32, day(0, 9), None), (33, *[dt.date(2020, 1, 20)] * 2), (34, *windows[0][1:])]
    rows = [(k, day(-5, 95)) for k in range(80)] * 2 + [(99, None), (98, dt.date(2029, 1, 2)), (97, dt.date(2029, 1, 1))]
    table = spark.createDataFrame(windows, "w int, a date, b date")
    got = walkforward.rows_in_windows(spark.createDataFrame(rows, "k int, ts date"), table, "a", "b")
    assert got.columns == ["k", "ts", "w", "a", "b"]
    want = [(*r, *w) for r in rows for w in windows if r[1] and w[1] and w[2] and w[1] <= r[1] <= w[2]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert walkforward.rows_in_windows(spark.createDataFrame(rows, "k int, ts date"), table.limit(0), "a", "b").count() == 0


def test_fold_arguments(market):
    for bad in ((0, 5, None), (5, 0, None), (5, 5, -1)):
        with pytest.raises(ValueError):
            walkforward.folds(market[0], *bad)


def test_walk_forward(spark, market):
    prices, universe, _ = market
    walk = trendlab.run_walk_forward(spark, CONFIG, prices, universe, insample=25, oos=10, anchored=False)
    rows = walk.summary.orderBy("fold").collect()
    assert len(rows) == 3 and all(r.is_end < r.oos_start for r in rows)
    phases = walkforward.phases(walk.nav, walk.folds).groupBy("fold", "phase").count().collect()
    assert {(r.fold, r.phase): r["count"] for r in phases} == {(f, p): n for f in (1, 2, 3) for p, n in (("IS", 25), ("OOS", 10))}
    assert trendlab.run_walk_forward(spark, CONFIG, prices, universe, insample=50, oos=11) is None


def test_sensitivity_curves(spark, market):
    prices, universe, _ = market
    template = api.run_backtest(spark, CONFIG, prices, universe)
    got = {r.lookback: r.sharpe for r in sensitivity.lookback_sensitivity(template, CONFIG, [4, 8]).collect()}
    assert set(got) == {4, 8}
    single = api.run_backtest(spark, CONFIG, prices, universe, parameter_overrides={"signals": {"momentum": {"lookbacks": [8]}}})
    assert got[8] == pytest.approx(single.summary.first().sharpe)
    curve = sensitivity.metric_sensitivity(
        template, CONFIG, "signals.momentum.lookbacks", [4, 8], base_overrides={"signals": {"momentum": {"skip_last_n": 2}}},
        value_adapter=lambda v: [v],
    )
    assert {r.parameter for r in curve.collect()} == {4, 8}
    with pytest.raises(KeyError):
        sensitivity.metric_sensitivity(template, CONFIG, "risk.target_portfolio_vol", [0.1], metric="alpha")


def test_bootstrap_against_numpy(spark):
    values = np.random.default_rng(4).normal(0.0005, 0.01, 120)
    table = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run_id string, idx int, ret double")
    got = {r.metric: r for r in bootstrap.confidence_intervals(table, n_samples=1500, block_size=10, seed=3).collect()}
    rng = np.random.default_rng(9)
    sharpes, falls = [], []
    for _ in range(1500):
        start = rng.integers(0, 111, 12)
        sample = np.concatenate([values[s : s + 10] for s in start])
        sharpes.append(math.sqrt(252) * sample.mean() / sample.std(ddof=1))
        nav = np.cumprod(1 + sample)
        falls.append((nav / np.maximum.accumulate(nav) - 1).min())
    for name, stats in (("sharpe", sharpes), ("max_drawdown", falls)):
        lo, hi = np.percentile(stats, [2.5, 97.5])
        width = hi - lo
        assert abs(got[name]["mean"] - np.mean(stats)) < 0.06 * width
        assert abs(got[name].lower - lo) < 0.15 * width and abs(got[name].upper - hi) < 0.15 * width


def test_bootstrap_shapes_and_seeds(spark):
    table = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.01, -0.005, 0.004, 0.012, -0.002])], "run_id string, idx int, ret double")
    draw = lambda *args: bootstrap.sample_rows(bootstrap.block_samples(table, *args))
    rows = draw(2, 50, 7)
    assert rows.groupBy("sample").count().filter("count <> 5").count() == 0
    assert rows.exceptAll(draw(2, 50, 7)).count() == 0
    assert rows.exceptAll(draw(2, 50, 8)).count() > 0
    whole = draw(99, 3)  # one block: every sample is the source
    assert whole.filter("sample = 2").orderBy("pos").select("ret").collect() == table.orderBy("idx").select("ret").collect()
    with pytest.raises(KeyError):
        bootstrap.confidence_intervals(table, ["alpha"])
    with pytest.raises(ValueError):
        bootstrap.block_samples(table, 0)


def _paths(returns, block, samples, starts):
    """Samples as the definition draws them, with numpy."""
    n = len(returns)
    b = min(block, n)
    for sample in range(samples):
        parts = [returns[starts(sample, k, n - b + 1) :][:b] for k in range(-(-n // b))]
        yield np.concatenate(parts)[:n]


@pytest.mark.parametrize("block", [1, 7, 20, 500])
def test_block_summaries_give_the_values_of_whole_samples(spark, block):
    rng = random.Random(block)
    runs = {
        "plain": [rng.gauss(0.001, 0.02) for _ in range(131)],
        "flat": [0.0] * 40 + [rng.gauss(0, 0.01) for _ in range(9)],
        "same": [0.004] * 33,
        "lost": [rng.choice([0.1, -0.05, -1.0]) for _ in range(50)],
        "owes": [rng.choice([0.3, -1.4, -0.2]) for _ in range(50)],
        "one": [0.02],
    }
    rows = [(run, i, r) for run, values in runs.items() for i, r in enumerate(values)]
    table = spark.createDataFrame(rows, "run_id string, idx int, ret double").repartition(3)
    starts = lambda s, k, c: (7 * s + 13 * k) % c
    lattice = lambda s, k, c: F.pmod(F.lit(7) * s + F.lit(13) * k, c)
    got = {(r.run_id, r.sample): r for r in bootstrap.block_stats(table, block_size=block, n_samples=120, start_of=lattice).collect()}
    assert len(got) == 120 * len(runs)
    for run, values in runs.items():
        for sample, path in enumerate(_paths(np.array(values), block, 120, starts)):
            std = path.std(ddof=1) if len(path) > 1 and path.max() > path.min() else 0.0
            nav = np.cumprod(1 + path)
            peak = np.maximum.accumulate(np.maximum(nav, 0))
            falls = np.divide(nav, peak, out=np.ones_like(nav), where=peak != 0) - 1
            assert got[run, sample].sharpe == pytest.approx(path.mean() / std * 252**0.5 if std else 0.0, rel=1e-6, abs=1e-9), (run, sample)
            assert got[run, sample].max_drawdown == pytest.approx(min(0.0, falls.min()), abs=1e-9), (run, sample)


@pytest.mark.parametrize("bins", [2, 1024])
def test_percentiles_are_exact_order_statistics(spark, bins):
    rng = random.Random(bins)
    groups = {"a": [rng.gauss(0, 1) for _ in range(999)], "b": [5.0] * 40, "c": [1.0], "d": [rng.choice([1.0, 2.0, 1e9]) for _ in range(77)], "e": [-1e300, 1e300, 0.0]}
    table = spark.createDataFrame([(g, v) for g, values in groups.items() for v in [*values, None]], "g string, v double").repartition(4)
    at = {"low": 0.025, "mid": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in bootstrap.exact_percentiles(table, ["g"], "v", at, bins).collect()}
    for g, values in groups.items():
        for name, p in at.items():
            assert got[g][name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), (g, name)


def test_a_bootstrap_or_walk_forward_of_nothing_raises(spark):
    with pytest.raises(ValueError, match="at least one finite return"):
        bootstrap.confidence_intervals(spark.createDataFrame([], "run_id string, idx int, ret double"))
    with pytest.raises(ValueError, match="at least one session"):
        api.run_walk_forward(spark, CONFIG, spark.createDataFrame([], "symbol string, ts date, close double"), None, insample=5, oos=5)


def test_anchored_folds_are_one_run_cut_at_their_ends(spark, market):
    prices, universe, days = market
    config = scenarios.settings_of(CONFIG, {"execution.roll_schedule": {"ES": [str(days[20]), str(days[29])]}})
    ends = [days[29], days[39], days[59]]
    splits = [{"start": days[0], "end": e} for e in ends] + [{"start": days[5], "end": days[39]}]
    runs = api.run_parameter_sweep(spark, config, prices, universe, parameter_grid={"risk.target_portfolio_vol": [0.1, 0.3]}, splits=splits).backtest
    assert len(runs._bases.rows) == 4
    whole = {name: table.collect() for name, table in runs.tables().items() if name in ("nav", "positions", "orders", "trades", "cash", "ledger")}
    for row in runs.rows:
        alone = api.build(spark, config, prices, universe, [{"run_id": row["run_id"], "config": {**config, "risk.target_portfolio_vol": row["target_vol"], "backtest.start": row["start"], "backtest.end": row["end"]}}])
        for name, table in alone.tables().items():
            if name in whole:
                key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                assert sorted(map(key, table.collect()), key=repr) == sorted((key(r) for r in whole[name] if r["run_id"] == row["run_id"]), key=repr), (row["run_id"], name)


def test_folds_that_differ_in_their_beginning_are_not_shared(spark, market):
    from trendlab.plans.backtest import same_beginning

    prices, _, days = market
    late = prices.filter((F.col("symbol") == "ES") | (F.col("ts") > F.lit(days[35])))
    still = prices.withColumn("close", F.when(F.col("ts") <= F.lit(days[35]), 5.0).otherwise(F.col("close")))
    assert same_beginning(prices, days[0], days[30], days[59], 10)
    assert not same_beginning(prices, days[0], days[30], days[59], 40)
    assert not same_beginning(late, days[0], days[30], days[59], 10)
    assert not same_beginning(still, days[0], days[30], days[59], 10)
    assert same_beginning(late, days[0], days[50], days[59], 10)
