"""Entry points: a configuration, a price panel and a universe in, lazy result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.backtest import Backtest, check_panel, replay_differences
from .plans.replay import changed_tables
from .plans.scenario_table import scenario_table, table_metadata
from .plans.scenarios import flatten, scenario_list, setting, typed_row
from .plans.sensitivity import ranked
from .plans.walkforward import folds, walk_forward_summary
from .sources.local import small_table
from .sources.sinks import stored


def _volume_source(config: Mapping, adv):
    if adv is not None:
        return adv
    settings = flatten(config)
    found = setting(settings, "execution.average_daily_volume")
    return found if found is not None else setting(settings, "execution.adv_contracts")


def _roll_table(spark: SparkSession, config: Mapping, roll_dates: DataFrame | None) -> DataFrame | None:
    schedule = setting(flatten(config), "execution.roll_schedule")
    if roll_dates is not None or not schedule:
        return roll_dates
    pairs = [(symbol, str(day)[:10]) for symbol, days in schedule.items() for day in days]
    if not pairs:
        return None
    return small_table(spark, pairs, "symbol string, day string").select("symbol", F.to_date("day").alias("ts"))


def build(
    spark: SparkSession,
    config: Mapping,
    prices: DataFrame,
    universe: DataFrame,
    scenarios: Sequence[Mapping] | DataFrame,
    adv=None,
    roll_dates: DataFrame | None = None,
) -> Backtest:
    """``scenarios``: a :func:`scenario_table`, or a list of few."""
    runs = scenarios if isinstance(scenarios, DataFrame) else tuple(typed_row(s) for s in scenarios)
    out = Backtest(spark, prices, universe, runs, _volume_source(config, adv), _roll_table(spark, config, roll_dates))
    check_panel(prices, out.windows)
    return out


def run_backtest(
    spark: SparkSession,
    config: Mapping,
    prices: DataFrame,
    universe: DataFrame,
    *,
    parameter_overrides: Mapping | None = None,
    seed: int | None = None,
    adv=None,
    roll_dates: DataFrame | None = None,
    check_reproducibility: bool | None = None,
) -> Backtest:
    """A single run.  ``prices(symbol, ts, close)``: missing prices are null or absent; a date may occur once."""
    scenarios = scenario_list(config, base_overrides=parameter_overrides, seeds=seed)
    return _replayed(check_reproducibility, spark, config, prices, universe, scenarios, adv, roll_dates)


def _replayed(check: bool | None, spark: SparkSession, config: Mapping, *parts) -> Backtest:
    """The runs, computed twice and compared if ``check`` or else the setting ``backtest.check_reproducibility`` says so."""
    first = build(spark, config, *parts)
    if setting(flatten(config), "backtest.check_reproducibility", False) if check is None else check:
        assert_reproducible(first.tables(), build(spark, config, *parts).tables())
    return first


def assert_reproducible(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame]) -> None:
    """Raise if a table differs. Digests decide first; only tables that differ in some digit are compared row by row, under a tolerance."""
    suspects = changed_tables(first, second)
    if not suspects:
        return
    found = replay_differences({n: first[n] for n in suspects}, {n: second[n] for n in suspects})
    changed = found.filter("n_missing + n_extra > 0").limit(1).collect()
    if changed:
        raise RuntimeError(f"the run is not reproducible: {changed[0].asDict()}")


@dataclass(frozen=True)
class Sweep:
    """All runs of a sweep; ``request`` is what it was asked for: configuration, grid, overrides, splits and seeds."""

    backtest: Backtest
    request: tuple

    @property
    def scenarios(self) -> tuple:
        """Every scenario as an object on the driver, for a look at few of them."""
        return tuple(scenario_list(*self.request))

    @property
    def metadata(self) -> DataFrame:
        return table_metadata(self.backtest.scenarios, self.request[2])

    def ranking(self, metric: str = "sharpe") -> DataFrame:
        return ranked(self.backtest.summary, self.metadata, metric)


def run_parameter_sweep(
    spark: SparkSession,
    config: Mapping,
    prices: DataFrame,
    universe: DataFrame,
    *,
    parameter_grid: Mapping[str, Sequence] | None = None,
    base_overrides: Mapping | None = None,
    splits: Sequence[Mapping] | None = None,
    seeds: Sequence[int] | int | None = None,
    adv=None,
    roll_dates: DataFrame | None = None,
    check_reproducibility: bool | None = None,
) -> Sweep:
    """All scenarios of a grid (times splits and seeds) as one plan; they are rows of a table, never objects on the driver."""
    request = (config, parameter_grid, base_overrides, splits, seeds)
    runs = _replayed(check_reproducibility, spark, config, prices, universe, scenario_table(spark, *request), adv, roll_dates)
    return Sweep(runs, request)


@dataclass(frozen=True)
class WalkForward:
    backtest: Backtest
    folds: DataFrame

    @cached_property
    def nav(self) -> DataFrame:
        """The NAV of every fold's run, written once: phases and whole runs are summarised from it."""
        runs = self.backtest.scenarios.select("run_id", "fold")
        return stored(self.backtest.nav.join(runs, "run_id"), "fold-nav")

    @property
    def summary(self) -> DataFrame:
        return walk_forward_summary(self.nav, self.folds, self.backtest.raw_fills)


def run_walk_forward(
    spark: SparkSession,
    config: Mapping,
    prices: DataFrame,
    universe: DataFrame,
    *,
    insample: int,
    oos: int,
    step: int | None = None,
    anchored: bool = True,
    parameter_overrides: Mapping | None = None,
    seed: int | None = None,
    adv=None,
    roll_dates: DataFrame | None = None,
    check_reproducibility: bool | None = None,
) -> WalkForward | None:
    """One run per fold, from its in-sample start to its out-of-sample end; None without a fold.

    The fold boundaries (a few dates per fold) are read once.
    """
    table = folds(prices, insample, oos, step, anchored)
    bounds = table.orderBy("fold").collect()
    if not bounds:
        if prices.isEmpty():
            raise ValueError("a walk-forward needs at least one session")
        return None
    known = small_table(spark, bounds, table.schema)
    splits = known.select("fold", F.col("is_start").alias("start"), F.col("oos_end").alias("end"))
    scenarios = scenario_table(spark, config, base_overrides=parameter_overrides, splits=splits, seeds=seed)
    backtest = _replayed(check_reproducibility, spark, config, prices, universe, scenarios, adv, roll_dates)
    return WalkForward(backtest, known)
