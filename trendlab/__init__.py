"""Systematic futures research on Spark: long-format tables in, long-format tables out.

Every operator takes and returns DataFrames and stays lazy.  A time series is identified by its
*key columns* (``("symbol",)`` for market data, ``("run_id", "symbol")`` inside a sweep) plus the
date column ``ts``; ``(keys, ts)`` is unique, so a window over one series is bounded by the number
of trading days, never by the number of scenarios, instruments or source rows.
"""

from .api import run_backtest, run_parameter_sweep, run_walk_forward

__all__ = ["run_backtest", "run_parameter_sweep", "run_walk_forward"]
