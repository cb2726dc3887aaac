"""One plan for any number of scenarios: prices in, every result table out.

Work is shared where scenarios agree.  Signals and volatilities are rows keyed by window, setting and
symbol, each distinct setting once; pairs of both that occur in runs are joined, and only then does
the panel fan out to its runs.  The plan is the same for one setting and for any number.  Runs with
equal settings and start are one run, cut at their ends.  From there the plan groups by
``(run, date)`` for the cross-sectional sizing and by ``(run, symbol)`` for holding, orders and fills.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import count

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attribution, calendar, execution, risk, signals
from ..operators.ledger import ledger
from ..operators.metrics import performance_summary, rolling_metrics
from ..operators.sizing import size_positions
from ..sources.local import small_table
from ..sources.sinks import stored
from .scenarios import FIELDS, fingerprint, scenario_frame
from .walkforward import rows_in_windows

SETTINGS_PER_PART = 4096  # of one window, joined by one key
_WINDOW = ("window_id", "symbol")
_RUN = ("run_id", "symbol")
_PARAMS = (
    "starting_nav", "target_vol", "gross_limit", "rebalance_threshold", "risk_allocator", "max_weight", "sector_caps",
    "default_adv", *execution.COST_COLUMNS,
)


def _signal_spec() -> Column:
    return F.struct("lookbacks", "skip_last_n")


def _vol_spec() -> Column:
    """Settings that matter to the volatility model of a run."""
    ewma = F.col("vol_model") == "ewma"
    lookback = F.when(ewma, 0).otherwise(F.col("vol_lookback"))
    return F.struct(
        F.col("vol_model").alias("model"),
        F.when(ewma, F.col("ewma_lambda")).otherwise(0.0).alias("lam"),
        F.when(F.col("min_vol_periods") != 0, F.col("min_vol_periods")).otherwise(lookback).alias("min_periods"),
        lookback.alias("lookback"),
    )


def check_panel(prices: DataFrame, windows: Sequence[tuple]) -> None:
    """Raise if an instrument has several prices on a date, or a window no price at all.

    One count per date reaches the driver, as many as the calendar has.
    """
    per_day = prices.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("known"))
    days = per_day.groupBy("ts").agg(F.max("n").alias("n"), F.sum("known").alias("known")).collect()
    if doubled := sorted(str(r["ts"]) for r in days if r["n"] > 1):
        raise ValueError(f"{len(doubled)} dates have more than one price for an instrument, the first is {doubled[0]}")
    quoted = sorted(r["ts"] for r in days if r["known"])
    for start, end in windows:
        at = bisect_left(quoted, start)
        if at == len(quoted) or quoted[at] > end:
            raise ValueError(f"no prices between {start} and {end}")


def dense_panel(rows: DataFrame) -> DataFrame:
    """A row for each instrument on every date of the table from its own first one on; new rows are null.

    Each row stands for the days up to the instrument's next one, as in alignment; of these the dates of the table stay.
    """
    by_symbol = Window.partitionBy("symbol").orderBy("ts")
    dates = rows.select("ts").distinct()
    last = dates.agg(F.max("ts").alias("last")).scalar()
    until = F.coalesce(F.date_sub(F.lead("ts").over(by_symbol), 1), last)
    values = [c for c in rows.columns if c not in ("symbol", "ts")]
    spans = rows.select("symbol", F.col("ts").alias("_own"), *values, F.greatest("ts", until).alias("_until"))
    spread = spans.withColumn("ts", F.explode(F.sequence("_own", "_until")))
    own = F.col("ts") == F.col("_own")
    filled = spread.select("symbol", "ts", *[F.when(own, F.col(c)).alias(c) for c in values])
    return filled.join(dates, "ts", "left_semi").select(*rows.columns)


def window_panel(spark: SparkSession, prices: DataFrame, windows: Sequence[tuple]) -> DataFrame:
    """The complete panel of each ``(start, end)`` window, keyed by ``window_id``; absent rows count as missing values."""
    rows = prices.select("symbol", "ts", "close", *[c for c in ("adv",) if c in prices.columns])
    lo, hi = min(w[0] for w in windows), max(w[1] for w in windows)
    rows = dense_panel(rows.filter(F.col("ts").between(F.lit(lo), F.lit(hi))))
    table = small_table(spark, [(i, a, b) for i, (a, b) in enumerate(windows)], "window_id int, w_start date, w_end date")
    inside = rows_in_windows(rows, table, "w_start", "w_end").drop("w_start", "w_end")
    if len(windows) == 1:  # no row lies outside
        inside = rows.withColumn("window_id", F.lit(0))
    return calendar.complete_panel(inside, scope=("window_id",))


def same_beginning(prices: DataFrame, start, first_end, last_end, warm_up: int) -> bool:
    """Whether a run from ``start`` to ``first_end`` is the beginning of the one to ``last_end``, whatever its settings.

    A run looks ahead in two places alone: the panel begins when its last instrument does, and the first volatility fills the
    sessions before it. So no instrument may appear after ``first_end``, and by then each must have moved within the
    panel, which must have ``warm_up`` sessions. Two small aggregates.
    """
    rows = prices.filter(F.col("close").isNotNull() & F.col("ts").between(F.lit(start), F.lit(last_end)))
    begin = rows.groupBy("symbol").agg(F.min("ts").alias("first")).agg(F.max("first")).first()[0]
    if begin is None or begin > first_end:
        return False
    early = rows.filter(F.col("ts").between(F.lit(begin), F.lit(first_end)))
    each = early.groupBy("symbol").agg((F.min("close") < F.max("close")).alias("moved"), F.count("*").alias("n"))
    found = each.agg(F.min("moved"), F.max("n"), F.count("*")).first()
    return bool(found[0]) and found[1] >= warm_up and found[2] == rows.select("symbol").distinct().count()


@dataclass(frozen=True)
class Backtest:
    """Result tables of one or many runs.

    All are lazy but two: ``book`` and the orders and fills have several readers each and are written to
    the shared scratch folder on first use, which also cuts the lineage of a long plan.
    """

    spark: SparkSession
    prices: DataFrame
    universe: DataFrame
    runs: DataFrame | Sequence[Mapping]  # a scenario table, or typed rows of few runs
    adv: object = None
    roll_dates: DataFrame | None = None
    allow_lookahead: bool = True

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.runs if isinstance(self.runs, DataFrame) else scenario_frame(self.spark, self.runs)

    @property
    def rows(self) -> tuple[dict, ...]:
        """The settings of all runs on the driver, for a look at few of them."""
        return tuple(r.asDict() for r in self.scenarios.orderBy("run_id").collect())

    @cached_property
    def _keyed(self) -> tuple[DataFrame, Row]:
        """Scenarios with ids of their signal and volatility settings, and what the plan has to know of them all.

        Ids are hashes of the settings, salted anew until different settings have different ids. Windows are as many as folds.
        """
        flag = lambda c: F.coalesce(F.max(c), F.lit(False))
        same = fingerprint(self.scenarios.select(*[c for c, *_ in FIELDS if c != "end"]), exclude=())
        for salt in count():
            keyed = self.scenarios.withColumn("_vol", _vol_spec()).withColumn("_same", same)
            keyed = keyed.withColumn("sig_id", F.xxhash64(F.lit(salt), _signal_spec())).withColumn("vol_id", F.xxhash64(F.lit(salt), "_vol"))
            facts = keyed.agg(
                F.count(F.lit(1)).alias("n"),
                F.array_sort(F.collect_set(F.struct("start", "end"))).alias("windows"),
                F.collect_set("vol_model").alias("models"),
                F.countDistinct(_signal_spec()).alias("sigs"),
                F.countDistinct("sig_id").alias("sig_ids"),
                F.countDistinct("_vol").alias("vols"),
                F.countDistinct("vol_id").alias("vol_ids"),
                F.countDistinct("_same").alias("n_same"),
                flag(F.col("rebalance_threshold") > 0).alias("banded"),
                flag(F.col("gross_limit") != 0).alias("grossed"),
                flag(F.size("sector_caps") > 0).alias("capped"),
                flag(F.col("max_weight") != 0).alias("clipped"),
            ).first()
            if facts["sigs"] == facts["sig_ids"] and facts["vols"] == facts["vol_ids"]:
                return keyed, facts

    @property
    def windows(self) -> list[tuple]:
        """The distinct ``(start, end)`` of the runs."""
        return [tuple(w) for w in self._keyed[1]["windows"]]

    @cached_property
    def _windowed(self) -> DataFrame:
        """Scenarios with the ids of their settings and of their window."""
        table = small_table(self.spark, [(i, *w) for i, w in enumerate(self.windows)], "window_id int, start date, end date")
        return self._keyed[0].join(table, ["start", "end"])

    @cached_property
    def _cuts(self) -> DataFrame | None:
        """``(_base, run_id, _end)`` of every run where some are beginnings of others, else None.

        Runs with equal settings and start are cut from the one that ends last, if :func:`same_beginning` says they may.
        """
        keyed, facts = self._keyed
        if facts["n_same"] == facts["n"]:
            return None
        alike = Window.partitionBy("_same")  # the runs of one setting: as many as folds
        rows = keyed.select(
            "run_id", "start", "end",
            F.first("run_id").over(alike.orderBy(F.desc("end"), "run_id")).alias("_base"),
            F.min("end").over(alike).alias("_shortest"),
            F.max("end").over(alike).alias("_longest"),
            F.count(F.lit(1)).over(alike).alias("_n"),
            F.when(F.col("min_vol_periods") != 0, F.col("min_vol_periods")).otherwise(F.col("vol_lookback")).alias("_warm_up"),
        )
        checks = rows.filter("_n > 1").groupBy("start", "_shortest", "_longest").agg(F.max("_warm_up")).collect()
        allowed = [tuple(c)[:3] for c in checks if c[1] == c[2] or same_beginning(self.prices, *c)]
        if not allowed:
            return None
        table = small_table(self.spark, [(*a, True) for a in allowed], "start date, _shortest date, _longest date, _may boolean")
        shared = F.coalesce("_may", F.lit(False)) & (F.col("_n") > 1)
        joined = rows.join(table, ["start", "_shortest", "_longest"], "left")
        base = F.when(shared, F.col("_base")).otherwise(F.col("run_id"))
        return stored(joined.select(base.alias("_base"), "run_id", F.col("end").alias("_end")), "cuts")

    @cached_property
    def _bases(self) -> Backtest | None:
        """The runs that are worked out where some are beginnings of others; None where each stands for itself."""
        if self._cuts is None:
            return None
        kept = self.scenarios.join(self._cuts.filter("_base = run_id").select("run_id"), "run_id", "left_semi")
        return replace(self, runs=stored(kept, "base-runs"))

    def _cut(self, table: DataFrame, day: str = "ts", last: bool = True) -> DataFrame:
        """Rows of base runs as rows of every run, up to its end; ``last`` says whether the last session counts.

        Nothing is ordered at the close of a last session, so orders end one session before all else.
        """
        inside = F.col(day) <= F.col("_end") if last else F.col(day) < F.col("_end")
        return table.withColumnRenamed("run_id", "_base").join(self._cuts, "_base").filter(inside).select(*table.columns)

    @cached_property
    def features(self) -> DataFrame:
        """``(window_id, sig_id, vol_id, symbol, ts, close, signal, vol)`` for every pair of settings that a run has."""
        facts = self._keyed[1]
        panel = window_panel(self.spark, self.prices, self.windows)
        if self._daily_volume:
            source = self.adv if isinstance(self.adv, DataFrame) else "adv"
            panel = calendar.align_volume(panel, source, None, _WINDOW)
        panel = stored(panel, "window-panel")
        parts = lambda settings: -(-settings // SETTINGS_PER_PART)
        sig_rows = self._windowed.select("window_id", "sig_id", "lookbacks", F.col("skip_last_n").alias("skip")).distinct()
        vol_rows = self._windowed.select("window_id", "vol_id", "_vol.*").distinct()
        signal = signals.momentum_by_setting(panel, sig_rows, _WINDOW, parts=parts(facts["sigs"]), carry=("adv",) if self._daily_volume else ())
        vol = risk.volatility_by_setting(panel, vol_rows, tuple(facts["models"]), _WINDOW, self.allow_lookahead, parts(facts["vols"]))
        pairs = self._windowed.select("window_id", "sig_id", "vol_id").distinct()
        return signal.join(pairs, ["window_id", "sig_id"]).join(vol, [*_WINDOW, "vol_id", "ts"])

    @property
    def _daily_volume(self) -> bool:
        """Volume that changes by day: a table of its own or the ``adv`` column of the prices."""
        return isinstance(self.adv, DataFrame) or (self.adv is None and "adv" in self.prices.columns)

    @cached_property
    def panel(self) -> DataFrame:
        """``(run_id, symbol, ts)`` with price, signal, volatility, volume and the run's parameters."""
        runs = self._windowed.select("run_id", "window_id", "sig_id", "vol_id", *_PARAMS)
        dims = self.universe.select("symbol", "sector", "point_value", "contract_step", F.col("pos").alias("symbol_pos"))
        fan = self.features.join(runs, ["window_id", "sig_id", "vol_id"]).join(dims, "symbol", "left")
        out = fan.select(
            "run_id", "symbol", "ts", "close", "sector",
            F.coalesce("point_value", F.lit(1.0)).alias("point_value"),
            F.coalesce("contract_step", F.lit(1.0)).alias("contract_step"),
            F.coalesce("symbol_pos", F.lit(2**31 - 1)).alias("symbol_pos"),
            "signal",
            "vol",
            F.element_at("sector_caps", F.col("sector")).alias("sector_cap"),
            *[c for c in _PARAMS if c != "sector_caps"],
            *(["adv"] if self._daily_volume else []),
        )
        if self._daily_volume:
            return out.withColumn("adv", F.coalesce("adv", "default_adv"))
        return calendar.align_volume(out, self.adv, F.col("default_adv"), _RUN)

    @cached_property
    def sized(self) -> DataFrame:
        """The panel with the ``target`` contracts of each session."""
        if self._bases:
            return self._cut(self._bases.book)
        facts = self._keyed[1]
        sized = size_positions(
            self.panel,
            capital=F.col("starting_nav"),
            target_vol=F.col("target_vol"),
            gross_limit=F.col("gross_limit") if facts["grossed"] else None,
            sector_cap="sector_cap" if facts["capped"] else None,
            threshold="rebalance_threshold" if facts["banded"] else 0.0,
            allocator=F.col("risk_allocator"),
            max_weight=F.col("max_weight") if facts["clipped"] else None,
            keys=_RUN,
            carry=("symbol_pos", "close", "adv", "point_value", "starting_nav", *execution.COST_COLUMNS),
        )
        return sized.select(
            *_RUN, "ts", "symbol_pos", "close", "adv", "point_value", "starting_nav", *execution.COST_COLUMNS, "target"
        )

    @cached_property
    def book(self) -> DataFrame:
        """``sized``, written once: orders, fills, positions and ledger all start from it."""
        return self.sized if self._bases else stored(self.sized, "book")

    def with_rolls(self, roll_dates: DataFrame) -> Backtest:
        return replace(self, roll_dates=roll_dates)

    @cached_property
    def _executed(self) -> tuple[DataFrame, DataFrame]:
        """Orders and fills before numbering, from one table of both that is written once."""
        if self._bases:
            orders, fills = self._bases._executed
            return self._cut(orders, "submitted", last=False), self._cut(fills)
        return execution.orders_and_fills(stored(execution.events(self.book, self.roll_dates), "events"))

    @property
    def raw_fills(self) -> DataFrame:
        """Fills before numbering: all that positions, costs and NAV need."""
        return self._executed[1]

    @cached_property
    def numbered_orders(self) -> DataFrame:
        if self._bases:
            return self._cut(self._bases.numbered_orders, "submitted", last=False)
        return execution.number_orders(self._executed[0])

    @property
    def orders(self) -> DataFrame:
        return self.numbered_orders.select("run_id", "order_id", "submitted", "symbol", "qty", "reason", "target")

    @cached_property
    def fills(self) -> DataFrame:
        if self._bases:
            return self._cut(self._bases.fills)
        navs = self.scenarios.select("run_id", "starting_nav")
        numbered = execution.with_order_ids(self.raw_fills, self.numbered_orders).join(navs, "run_id")
        cash = execution.cash_after_fills(numbered, F.col("starting_nav"))
        return cash.select(
            "run_id", "ts", "symbol", "qty", "price", "notional", "slippage", "commission", "cost", "reason",
            "order_id", "partial", "cash_after",
        )

    @cached_property
    def positions(self) -> DataFrame:
        if self._bases:
            return self._cut(self._bases.positions)
        return execution.positions_from_fills(self.book, self.raw_fills).select(
            *_RUN, "ts", "close", "point_value", "pos"
        )

    @cached_property
    def ledger(self) -> DataFrame:
        if self._bases:
            return self._cut(self._bases.ledger)
        return ledger(self.positions, self.raw_fills, self.scenarios.select("run_id", "starting_nav"))

    @property
    def nav(self) -> DataFrame:
        return self.ledger.select("run_id", "ts", "nav")

    @property
    def contributions(self) -> DataFrame:
        return attribution.pnl_contributions(self.positions)

    @property
    def sector_contributions(self) -> DataFrame:
        return attribution.sector_contributions(self.contributions, self.universe)

    @property
    def exposures(self) -> DataFrame:
        return attribution.exposures(self.positions)

    @property
    def roll_costs(self) -> DataFrame:
        return attribution.cost_breakdown(self.ledger, self.raw_fills)

    def rolling_stats(self, window: int = 126) -> DataFrame:
        return rolling_metrics(self.nav, window)

    @cached_property
    def summary(self) -> DataFrame:
        return performance_summary(self.nav, self.raw_fills)

    def tables(self, rolling_window: int = 126) -> dict[str, DataFrame]:
        """Every result table by name, as written by the run bundle."""
        return {
            "nav": self.nav,
            "positions": self.positions.select(*_RUN, "ts", "pos"),
            "orders": self.orders,
            "trades": self.fills,
            "cash": self.ledger.select("run_id", "ts", "cash"),
            "ledger": self.ledger,
            "contributions": self.contributions,
            "sector_contributions": self.sector_contributions,
            "exposures": self.exposures,
            "roll_costs": self.roll_costs,
            "rolling_stats": self.rolling_stats(rolling_window),
        }


def replay_differences(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame], tolerance: float = 1e-9) -> DataFrame:
    """``(artefact, n_missing, n_extra)``: rows of one set of result tables without an equal in the other.

    Floating-point columns are equal within ``tolerance`` of their size, as the order in which a shuffle brings terms
    together moves the last bits of a sum; all other columns are equal exactly.  One aggregate per table.
    """
    out = None
    for name, left in first.items():
        values = [f.name for f in left.schema.fields if f.dataType.typeName() in ("double", "float")]
        keys = [c for c in left.columns if c not in values]
        both = left.withColumn("_side", F.lit(1)).unionByName(second[name].select(left.columns).withColumn("_side", F.lit(-1)))
        moved = F.lit(False)
        for c in values:
            net, size = F.sum(F.coalesce(c, F.lit(0.0)) * F.col("_side")), F.sum(F.abs(F.coalesce(c, F.lit(0.0))))
            moved = moved | (F.abs(net) > tolerance * (size + 1)) | (F.sum(F.when(F.col(c).isNull(), F.col("_side")).otherwise(0)) != 0)
        groups = both.groupBy(*keys).agg(F.sum("_side").alias("_net"), moved.alias("_moved"))
        differs = F.when((F.col("_net") == 0) & F.col("_moved"), 1).otherwise(0)
        row = groups.agg(
            F.coalesce(F.sum(F.greatest("_net", differs)), F.lit(0)).alias("n_missing"),
            F.coalesce(F.sum(F.greatest(-F.col("_net"), differs)), F.lit(0)).alias("n_extra"),
        ).select(F.lit(name).alias("artefact"), "n_missing", "n_extra")
        out = row if out is None else out.unionByName(row)
    return out
