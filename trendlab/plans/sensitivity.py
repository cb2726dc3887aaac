"""Sweep tables and one-parameter curves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import METRICS
from ..sources.local import small_table
from .backtest import Backtest
from .scenario_table import numbered_rows
from .scenarios import scenario_list, settings_of, typed_row


def ranked(summary: DataFrame, scenarios: DataFrame, metric: str = "sharpe") -> DataFrame:
    """One row per scenario with its settings, metrics and rank (best first), ranked by ranges."""
    return numbered_rows(scenarios.join(summary, "run_id"), [F.col(metric).desc_nulls_last(), F.col("run_id")])


def metric_sensitivity(
    template: Backtest,
    config: Mapping,
    parameter: str,
    values: Iterable,
    metric: str = "sharpe",
    base_overrides: Mapping | None = None,
    value_adapter: Callable | None = None,
    label: str = "parameter",
) -> DataFrame:
    """``(label, metric)`` for each value of one dotted setting, as a single sweep."""
    if metric not in METRICS:
        raise KeyError(f"no summary column {metric!r} to rank or plot by")
    values = list(values)
    adapt = value_adapter or (lambda v: v)
    rows = []
    for i, value in enumerate(values):
        override = settings_of(base_overrides, {parameter: adapt(value)})
        scenario = scenario_list(config, base_overrides=override)[0]
        rows.append(typed_row({**scenario, "run_id": f"run-{i + 1:04d}"}))
    sweep = Backtest(
        template.spark, template.prices, template.universe, tuple(rows), template.adv, template.roll_dates,
        template.allow_lookahead,
    )
    kind = "bigint" if all(isinstance(v, int) for v in values) else "double"
    if not all(isinstance(v, (int, float)) for v in values):
        kind = "string"
    shown = [str(v) if kind == "string" else v for v in values]
    names = small_table(
        template.spark, [(r["run_id"], v) for r, v in zip(rows, shown, strict=True)], f"run_id string, `{label}` {kind}"
    )
    curve = sweep.summary
    if metric == "turnover":  # the curve looks at the NAV alone
        curve = curve.withColumn("turnover", F.lit(0.0))
    return names.join(curve.select("run_id", metric), "run_id").select(label, metric)


def lookback_sensitivity(template: Backtest, config: Mapping, lookbacks: Iterable[int], metric: str = "sharpe") -> DataFrame:
    return metric_sensitivity(
        template, config, "signals.momentum.lookbacks", lookbacks, metric, value_adapter=lambda v: [v], label="lookback"
    )


def vol_target_sensitivity(template: Backtest, config: Mapping, targets: Iterable[float], metric: str = "sharpe") -> DataFrame:
    return metric_sensitivity(
        template, config, "risk.target_portfolio_vol", targets, metric, value_adapter=float, label="vol_target"
    )
