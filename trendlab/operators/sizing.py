"""Volatility-targeted position sizing.

The cross-sectional steps (budget, sector caps, gross limit) group by ``(run, date)``; their window
frames hold the instruments of one date, so their size is that of the universe.  Parameters may be
numbers or scenario columns, which is how one plan sizes every scenario of a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scaling import finite_or_zero, to_contracts
from ..functions.series import Keys, as_col, cross_section, ratio


def risk_budget(panel: DataFrame, allocator="proportional", keys: Keys = ("symbol",)) -> DataFrame:
    """Add ``budget``: the share of each instrument in the date's risk.

    ``proportional`` follows the signal strength; ``erc`` (also ``equal_active``) gives the same
    share to every instrument with a signal.  ``allocator`` may be a column.
    """
    if isinstance(allocator, str) and allocator not in ("proportional", "erc", "equal_active"):
        raise ValueError(f"no allocator has the name {allocator!r}")
    strength = F.abs("signal")
    equal = as_col(allocator).isin("erc", "equal_active")
    stake = F.when(equal, (strength > 0).cast("double")).otherwise(strength)
    total = F.sum("_stake").over(cross_section(keys))
    panel = panel.withColumn("_stake", stake)
    return panel.withColumn("budget", F.coalesce(ratio(F.col("_stake"), total), F.lit(0.0))).drop("_stake")


def sector_capped(panel: DataFrame, cap: Column | str = "sector_cap", keys: Keys = ("symbol",)) -> DataFrame:
    """Scale a sector's budgets pro rata where they add up to more than its cap (null: no cap)."""
    cap = F.col(cap) if isinstance(cap, str) else cap
    by_sector = Window.partitionBy(*[k for k in keys if k != "symbol"], "ts", "sector")
    total = F.sum("budget").over(by_sector)
    panel = panel.withColumn("_total", total)
    scaled = F.when(F.col("_total") > cap, F.col("budget") * cap / F.col("_total"))
    return panel.withColumn("budget", F.coalesce(scaled, F.col("budget"))).drop("_total")


def vol_target_weight(panel: DataFrame, target_vol=0.15) -> DataFrame:
    """Add ``weight``: budget times target over volatility, signed; 0 without a volatility."""
    raw = ratio(F.col("budget") * as_col(target_vol), F.col("vol"))
    return panel.withColumn("weight", finite_or_zero(raw) * F.signum("signal"))


def clip_weight(panel: DataFrame, max_weight=None) -> DataFrame:
    if max_weight is None:
        return panel
    bound = as_col(max_weight)
    clipped = F.greatest(-bound, F.least(bound, F.col("weight")))
    return panel.withColumn("weight", F.when(bound > 0, clipped).otherwise(F.col("weight")))


def limit_gross(panel: DataFrame, limit=3.0, keys: Keys = ("symbol",)) -> DataFrame:
    """Scale all weights of a date down to the gross exposure limit; null or <= 0 disables."""
    if limit is None:
        return panel
    limit = as_col(limit)
    panel = panel.withColumn("_gross", F.sum(F.abs("weight")).over(cross_section(keys)))
    over = (limit > 0) & (F.col("_gross") > limit)
    scale = F.when(over, limit / F.col("_gross")).otherwise(1.0)
    return panel.withColumn("weight", F.col("weight") * scale).drop("_gross")


def contracts_for(panel: DataFrame, capital=1_000_000.0) -> DataFrame:
    """Add ``contracts``: the unrounded holding for the weight at the day's price."""
    value = F.col("close") * F.coalesce("point_value", F.lit(1.0))
    held = ratio(F.col("weight") * as_col(capital), value)
    return panel.withColumn("contracts", F.coalesce(held, F.lit(0.0)))


def _hold_series(desired: np.ndarray, prev: float, threshold: float, step: float) -> np.ndarray:
    """Walk one series: keep the held size while the wanted change is below the threshold."""
    rounded = np.rint(desired / step) * step
    if threshold <= 0:
        return rounded
    out = np.empty(len(desired))
    held = prev
    for i, (want, lots) in enumerate(zip(desired.tolist(), rounded.tolist(), strict=True)):
        if abs(want - held) >= threshold:
            held = lots
        elif i == 0:  # an opening holding may be off the grid; later ones never are
            held = float(np.rint(prev / step)) * step
        out[i] = held
    return out


def no_trade_band(
    panel: DataFrame,
    threshold=0.25,
    step="contract_step",
    keys: Keys = ("symbol",),
    start: str | None = None,
) -> DataFrame:
    """Add ``target``: rounded contracts that move only when the wanted change reaches the threshold.

    Each day depends on what was held the day before, so this is a fold per series (bounded by its
    sessions), done on Arrow batches.  ``threshold`` may be a column name; ``start`` names a column
    with the opening holding.  Without a threshold it is a plain expression.
    """
    keys = list(keys)
    step_col = F.col(step) if isinstance(step, str) else as_col(float(step))
    panel = panel.withColumn("contracts", finite_or_zero(F.col("contracts")))
    if isinstance(threshold, (int, float)) and threshold <= 0:
        return panel.withColumn("target", to_contracts(F.col("contracts"), step_col))
    limit = F.col(threshold) if isinstance(threshold, str) else as_col(float(threshold))
    rows = panel.withColumn("_thr", F.greatest(F.coalesce(limit, F.lit(0.0)), F.lit(0.0)).cast("double"))
    rows = rows.withColumn("_step", F.when(step_col > 0, step_col).otherwise(1.0).cast("double"))
    rows = rows.withColumn("_start", F.coalesce(F.col(start) if start else F.lit(0.0), F.lit(0.0)))

    def fold(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("ts")
        desired = batch["contracts"].to_numpy()
        target = _hold_series(desired, batch["_start"][0].as_py(), batch["_thr"][0].as_py(), batch["_step"][0].as_py())
        return batch.drop_columns(["_thr", "_step", "_start"]).append_column("target", pa.array(target + 0.0))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return rows.groupBy(*keys).applyInArrow(fold, f"{out}, `target` double")


def size_positions(
    panel: DataFrame,
    *,
    capital=1_000_000.0,
    target_vol=0.15,
    gross_limit=3.0,
    sector_cap: Column | str | None = None,
    step="contract_step",
    threshold=0.25,
    allocator="proportional",
    max_weight=None,
    keys: Keys = ("symbol",),
    start: str | None = None,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """From ``signal``, ``vol``, ``close``, ``point_value`` (and ``sector``) to ``target`` contracts.

    Order: budget, sector caps, volatility target, clip, gross limit, contracts, no-trade band.  ``carry`` names the
    columns that are still needed afterwards, so that the band does not move the others; None keeps all.
    """
    out = risk_budget(panel, allocator, keys)
    if sector_cap is not None:
        out = sector_capped(out, sector_cap, keys)
    out = vol_target_weight(out, target_vol)
    out = clip_weight(out, max_weight)
    out = limit_gross(out, gross_limit, keys)
    out = contracts_for(out, capital)
    if carry is not None:
        used = [c for c in (step, threshold, start) if isinstance(c, str)]
        out = out.select(*dict.fromkeys((*keys, "ts", *carry, "contracts", *used)))
    return no_trade_band(out, threshold, step, keys, start)


__all__ = [
    "clip_weight",
    "contracts_for",
    "limit_gross",
    "no_trade_band",
    "risk_budget",
    "sector_capped",
    "size_positions",
    "vol_target_weight",
]
