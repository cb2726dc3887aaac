"""Scenario tables: one typed row per run.

A configuration has the sections ``signals.momentum``, ``risk``, ``execution`` and ``backtest``, nested or by
dotted name; inside, settings are flat.  Grids name settings by dotted key.  The lists made here are for few runs; sweeps
take their scenarios from a table (``scenario_table``).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.local import small_table

# column, dotted setting(s) in order of preference, Spark type, default
FIELDS: tuple[tuple[str, tuple[str, ...], str, object], ...] = (
    ("start", ("backtest.start",), "date", None),
    ("end", ("backtest.end",), "date", None),
    ("starting_nav", ("backtest.starting_nav",), "double", 1_000_000.0),
    ("seed", ("backtest.seed",), "int", 0),
    ("lookbacks", ("signals.momentum.lookbacks",), "array<int>", (63, 126, 252)),
    ("skip_last_n", ("signals.momentum.skip_last_n",), "int", 20),
    ("target_vol", ("risk.target_portfolio_vol",), "double", 0.15),
    ("gross_limit", ("risk.gross_exposure_limit",), "double", 3.0),
    ("rebalance_threshold", ("risk.rebalance_threshold",), "double", 0.25),
    ("risk_allocator", ("risk.risk_allocator",), "string", "proportional"),
    ("max_weight", ("risk.max_instrument_weight", "risk.max_instrument_vol_weight"), "double", None),
    ("sector_caps", ("risk.sector_caps",), "map<string,double>", None),
    ("vol_model", ("risk.vol_model",), "string", "ewma"),
    ("vol_lookback", ("risk.vol_lookback",), "int", 63),
    ("ewma_lambda", ("risk.ewma_lambda",), "double", 0.94),
    ("min_vol_periods", ("risk.min_vol_periods",), "int", 20),
    ("commission_per_contract", ("execution.commission_per_contract",), "double", 0.0),
    ("impact_k", ("execution.impact.k",), "double", 0.0),
    ("impact_alpha", ("execution.impact.alpha",), "double", 1.0),
    ("tick_value", ("execution.tick_value",), "double", 1.0),
    ("min_slippage_ticks", ("execution.min_slippage_ticks",), "double", 0.0),
    ("adv_limit_pct", ("execution.adv_limit_pct",), "double", 0.0),
    ("default_adv", ("execution.default_adv_contracts",), "double", 10_000.0),
)


def flatten(config: Mapping | None, prefix: str = "") -> dict:
    """Settings by dotted name, whether ``config`` nests its sections or names them with dots already."""
    flat: dict = {}
    for name, value in (config or {}).items():
        dotted = prefix + str(name)
        flat.update(flatten(value, f"{dotted}.") if isinstance(value, Mapping) else {dotted: value})
    return flat


def settings_of(*layers: Mapping | None) -> dict:
    """Flat settings of several configurations, later ones first in force.

    A value given to a section's own name replaces the section; a value inside it replaces the section's single value.
    """
    out: dict = {}
    for layer in layers:
        new = flatten(layer)
        hidden = {k for k in out for n in new if k.startswith(f"{n}.") or n.startswith(f"{k}.")}
        out = {k: v for k, v in out.items() if k not in hidden} | new
    return out


def setting(settings: Mapping, dotted: str, default=None):
    """One flat setting; where only names below ``dotted`` are set, they come as a mapping."""
    below = {k[len(dotted) + 1 :]: v for k, v in settings.items() if k.startswith(f"{dotted}.")}
    return below or settings.get(dotted, default)


def sections(settings: Mapping) -> dict:
    """Flat settings as nested sections, the form in which records show them."""
    tree: dict = {}
    for dotted, value in sorted(settings.items()):
        *above, name = dotted.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[name] = value
    return tree


def expand_grid_frame(rows: DataFrame, grid: Mapping[str, Sequence | Column]) -> DataFrame:
    """A grid as a table: every row of ``rows`` times every combination of the values.

    Each parameter is one ``explode`` of an array (a list of literals or an array column), so a grid
    over a table needs no cross join.  ``grid_pos`` numbers the combinations, last key fastest.
    """
    position = F.lit(0)
    out = rows
    for name, values in grid.items():
        array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        out = out.withColumn("_grid", array).select(
            "*", F.size("_grid").alias(f"_n_{name}"), F.posexplode("_grid").alias(f"_p_{name}", name)
        ).drop("_grid")
        position = position * F.col(f"_n_{name}") + F.col(f"_p_{name}")
    helpers = [f"_{kind}_{name}" for name in grid for kind in ("n", "p")]
    return out.withColumn("grid_pos", position).drop(*helpers)


def scenario_list(
    config: Mapping,
    grid: Mapping[str, Sequence] | None = None,
    base_overrides: Mapping | None = None,
    splits: Iterable[Mapping] | None = None,
    seeds: Sequence[int] | int | None = None,
) -> list[dict]:
    """Every split with every combination of grid values and seeds: flat settings and where they come from.

    Runs are numbered with the seed varying fastest, then the last grid setting; splits vary slowest.
    """
    base = settings_of(config, base_overrides)
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())] if grid else [{}]
    windows = [{f"backtest.{edge}": str(split[edge])[:10] for edge in ("start", "end") if split.get(edge)} for split in splits or ({},)]
    draws = seeds if isinstance(seeds, Sequence) else (seeds,)
    runs = enumerate(product(enumerate(windows, 1), points, draws), 1)
    return [
        {
            "run_id": f"run-{number:04d}",
            "fold": fold,
            "config": settings_of(base, point, window, {} if draw is None else {"backtest.seed": int(draw)}),
            "grid_overrides": flatten(point),
            "base_overrides": flatten(base_overrides),
            "run_seed": draw,
        }
        for number, ((fold, window), point, draw) in runs
    ]


def _typed(kind: str, value):
    if value is None:
        return None
    if kind == "array<int>":
        return [int(v) for v in value]
    if kind == "map<string,double>":
        return {str(k): float(v) for k, v in value.items()}
    return {"double": float, "int": int, "string": str, "date": lambda v: _date(v)}[kind](value)


def _date(value):
    return datetime.date.fromisoformat(str(value)[:10])


def typed_row(scenario: Mapping) -> dict:
    """The settings of one scenario under their column names."""
    row = {"run_id": scenario["run_id"], "fold": scenario.get("fold", 1)}
    settings = flatten(scenario["config"])
    for column, dotted, kind, default in FIELDS:
        found = next((v for v in (setting(settings, d) for d in dotted) if v is not None), None)
        disabled = column == "gross_limit" and "risk.gross_exposure_limit" in settings
        row[column] = _typed(kind, found if found is not None else (None if disabled else default))
    if row["start"] is None or row["end"] is None:
        raise ValueError(f"{row['run_id']}: backtest.start is {row['start']}, backtest.end is {row['end']}; set both")
    if any(lb <= 0 for lb in row["lookbacks"]):
        raise ValueError(f"{row['run_id']}: signals.momentum.lookbacks has {min(row['lookbacks'])}, which is not above 0")
    if row["vol_model"] not in ("ewma", "rolling"):
        raise ValueError(f"{row['run_id']}: risk.vol_model is {row['vol_model']!r}, neither 'ewma' nor 'rolling'")
    if row["risk_allocator"] not in ("proportional", "erc", "equal_active"):
        raise ValueError(f"{row['run_id']}: no allocator has the name {row['risk_allocator']!r}")
    return row


def scenario_frame(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Typed scenario rows as a table with their fingerprint."""
    schema = "run_id string, fold int, " + ", ".join(f"`{c}` {k}" for c, _, k, _ in FIELDS)
    columns = ["run_id", "fold", *[c for c, *_ in FIELDS]]
    frame = small_table(spark, [tuple(r.get(c) for c in columns) for r in rows], schema)
    return frame.withColumn("config_hash", fingerprint(frame, exclude=("run_id", "fold")))


def fingerprint(rows: DataFrame, exclude: Sequence[str] = ("run_id",)) -> Column:
    """SHA-256 over the settings as JSON, columns in name order: equal settings, equal hash."""
    names = sorted(c for c in rows.columns if c not in exclude)
    parts = []
    for name in names:
        if isinstance(rows.schema[name].dataType, T.MapType):
            # entries in key order, so the order in which caps were written does not matter
            parts.append(F.array_sort(F.map_entries(name)).alias(name))
        else:
            parts.append(F.col(name))
    return F.sha2(F.to_json(F.struct(*parts)), 256)
