"""Transaction-cost expressions; every parameter may be a number or a scenario column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .series import as_col, ratio


def commission(qty: Column, per_contract) -> Column:
    return F.abs(qty) * as_col(per_contract)


def participation_slippage(
    qty: Column, adv: Column, *, k, alpha, tick_value, min_ticks
) -> Column:
    """Ticks grow with the share of daily volume, with a floor; unknown volume pays full impact."""
    share = F.least(ratio(F.abs(qty), adv), F.lit(1.0))
    ticks = F.when(adv <= 0, F.greatest(as_col(min_ticks), as_col(k))).otherwise(
        F.greatest(as_col(min_ticks), as_col(k) * F.pow(share, as_col(alpha)))
    )
    return F.when(qty == 0, 0.0).otherwise(F.abs(qty) * ticks * as_col(tick_value))


def notional_slippage(notional: Column, k=0.05, alpha=0.5, tick_value=10.0, min_ticks=0.5) -> Column:
    floor = as_col(min_ticks) * as_col(tick_value)
    return F.greatest(as_col(k) * F.pow(F.abs(notional), as_col(alpha)), floor)
