"""Attribution and metrics on small tables."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from trendlab.operators import attribution, metrics

NAV = [1_000_000, 1_010_000, 1_020_000, 1_015_000, 1_025_000, 1_040_000]


@pytest.fixture(scope="module")
def nav(spark, weekdays):
    days = weekdays("2020-01-01", 6)
    return spark.createDataFrame([("r", d, float(v)) for d, v in zip(days, NAV, strict=True)], "run_id string, ts date, nav double")


def test_summary_against_pandas(spark, nav):
    trades = spark.createDataFrame([("r", v) for v in (200_000.0, 150_000.0, 50_000.0)], "run_id string, notional double")
    row = metrics.performance_summary(nav, trades).first()
    series = pd.Series(NAV, dtype=float)
    rets = series.pct_change().dropna()
    vol = rets.std() * math.sqrt(252)
    assert row.turnover == pytest.approx(400_000 / series.mean())
    assert row.cagr == pytest.approx((NAV[-1] / NAV[0]) ** (252 / 5) - 1)
    assert row.volatility == pytest.approx(vol) and row.sharpe == pytest.approx(rets.mean() * 252 / vol)
    assert row.sortino == pytest.approx(rets.mean() * 252 / (math.sqrt((rets[rets < 0] ** 2).mean()) * math.sqrt(252)))
    assert row.max_drawdown == pytest.approx((series / series.cummax() - 1).min())
    assert row.calmar == pytest.approx(row.cagr / abs(row.max_drawdown))
    assert row["skew"] == pytest.approx(rets.skew()) and row["kurtosis"] == pytest.approx(rets.kurtosis())
    assert row.hit_rate == pytest.approx(0.8)


def test_summary_edge_cases(spark, weekdays):
    days = weekdays("2020-01-01", 5)
    rows = [("flat", d, 100.0) for d in days] + [("one", days[0], 100.0)]
    table = spark.createDataFrame(rows, "run_id string, ts date, nav double")
    runs = spark.createDataFrame([("flat",), ("one",), ("none",)], "run_id string")
    got = {r.run_id: r.asDict() for r in metrics.performance_summary(table, runs=runs).collect()}
    assert all(v == 0 for k, v in got["none"].items() if k != "run_id")
    assert all(v == 0 for k, v in got["flat"].items() if k != "run_id")
    assert got["one"]["cagr"] == got["one"]["sharpe"] == got["one"]["max_drawdown"] == 0


def test_rolling_metrics_scale(nav):
    rows = metrics.rolling_metrics(nav, 3).orderBy("ts").collect()
    rets = pd.Series(NAV, dtype=float).pct_change().dropna()
    mean, std = rets.rolling(3).mean().dropna(), rets.rolling(3).std().dropna()
    assert [r.rolling_vol for r in rows] == pytest.approx((std * math.sqrt(252)).tolist())
    assert [r.rolling_sharpe for r in rows] == pytest.approx((mean * 252 / std).tolist())
    assert [r.rolling_sharpe_ann for r in rows] == pytest.approx((mean * 252 / (std * math.sqrt(252))).tolist())


def test_histogram_against_numpy(nav):
    rets = pd.Series(NAV, dtype=float).pct_change().dropna()
    want, edges = np.histogram(rets, bins=50)
    rows = metrics.histogram(nav).orderBy("bin").collect()
    assert [r.n for r in rows] == want.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1].tolist())


@pytest.fixture(scope="module")
def positions(spark, weekdays):
    days = weekdays("2021-01-01", 3)
    data = {"A": ([100, 101, 102], [0, 1, 1], 1.0), "B": ([50, 52, 51], [0, -1, -1], 2.0)}
    rows = [
        ("r", s, d, float(p), float(c), pv) for s, (cs, ps, pv) in data.items() for d, c, p in zip(days, cs, ps, strict=True)
    ]
    return spark.createDataFrame(rows, "run_id string, symbol string, ts date, pos double, close double, point_value double")


def test_contributions_and_exposures(spark, positions):
    last, mid = dt.date(2021, 1, 5), dt.date(2021, 1, 4)
    contrib = attribution.pnl_contributions(positions)
    got = {(r.symbol, r.ts): r.pnl for r in contrib.collect()}
    assert (got["A", last], got["B", last]) == (1.0, 2.0)
    sectors = spark.createDataFrame([("A", "Alpha")], "symbol string, sector string")
    by_sector = {(r.sector, r.ts): r.pnl for r in attribution.sector_contributions(contrib, sectors).collect()}
    assert by_sector["Alpha", last] == 1.0 and by_sector["Unknown", last] == 2.0
    exposure = {(r.symbol, r.ts): r.exposure for r in attribution.exposures(positions).collect()}
    assert (exposure["A", mid], exposure["B", mid]) == (101.0, -104.0)


def test_cost_breakdown_and_other(spark):
    rows = spark.createDataFrame([("r", 1.0, 0.5, 1.5), ("r", 2.0, 0.5, 2.5)], "run_id string, trading_cost double, roll_cost double, total_cost double")
    fills = spark.createDataFrame([("r", "rebalance", 3.0), ("r", "roll", 2.0), ("r", None, 1.0)], "run_id string, reason string, cost double")
    got = {r.component: r.amount for r in attribution.cost_breakdown(rows, fills).collect()}
    assert got == {"ledger_trading": 3, "ledger_roll": 1, "ledger_total": 4, "trades_rebalance": 3, "trades_roll": 2, "trades_unknown": 1}
    totals = spark.createDataFrame([("r", "A", 10.0), ("r", "B", -5.0), ("r", "C", 1.0), ("r", "D", 0.5)], "run_id string, symbol string, pnl double")
    top = {r.place: (r.symbol, r.pnl) for r in attribution.top_and_other(totals, 3).collect()}
    assert top == {1: ("A", 10), 2: ("B", -5), 3: ("Other", 1.5)}
    assert attribution.top_and_other(totals, 4).filter("symbol = 'Other'").count() == 0


@pytest.mark.parametrize(("block", "batch"), [(1, 7), (2, 1), (3, 5), (256, 10_000)])
def test_correlation_against_pandas(spark, weekdays, monkeypatch, block, batch):
    monkeypatch.setattr(attribution, "_BLOCK", block)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # pairs of strips are split between batches
    rng = np.random.default_rng(2)
    days = weekdays("2021-01-01", 80)
    wide = pd.DataFrame(100 * np.exp(rng.normal(0, 0.01, (80, 4)).cumsum(axis=0)), columns=list("ABCD"))
    rows = [("r", s, d, None if s == "A" and i == 7 else float(v)) for s in wide for i, (d, v) in enumerate(zip(days, wide[s], strict=True))]
    table = spark.createDataFrame(rows, "run_id string, symbol string, ts date, close double")
    wide.iloc[7, 0] = np.nan
    want = wide.pct_change(fill_method=None).dropna().corr()
    got = attribution.return_correlation(table).toPandas().pivot(index="symbol_a", columns="symbol_b", values="corr")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)
