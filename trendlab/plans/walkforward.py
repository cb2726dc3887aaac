"""Walk-forward folds by trading-day count, and what happens inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import METRICS, performance_summary


def folds(
    sessions: DataFrame, insample: int, oos: int, step: int | None = None, anchored: bool = True
) -> DataFrame:
    """``(fold, is_start, is_end, oos_start, oos_end)`` over the distinct dates of ``sessions``.

    A fold needs its whole out-of-sample window; ``step`` defaults to ``oos``; anchored folds all
    start on the first date.  The fold starts are a sequence of date positions; dates are found by
    equi-join on the position.
    """
    if insample <= 0 or oos <= 0:
        raise ValueError(f"a fold of {insample} + {oos} sessions: each part needs at least one")
    step = step or oos
    if step <= 0:
        raise ValueError(f"folds cannot advance by {step} sessions")
    days = sessions.select("ts").distinct()
    # One row per trading day: the only place where a whole calendar is numbered in one task.
    numbered = days.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("pos"))
    last_start = F.count(F.lit(1)) - insample - oos
    starts = (
        days.agg(last_start.cast("int").alias("last"))
        .filter("last >= 0")
        .select(F.posexplode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("i", "at"))
    )
    edges = starts.select(
        (F.col("i") + 1).alias("fold"),
        F.explode(
            F.array(
                F.struct(F.lit("is_start").alias("edge"), (F.lit(0) if anchored else F.col("at")).alias("pos")),
                F.struct(F.lit("is_end").alias("edge"), (F.col("at") + insample - 1).alias("pos")),
                F.struct(F.lit("oos_start").alias("edge"), (F.col("at") + insample).alias("pos")),
                F.struct(F.lit("oos_end").alias("edge"), (F.col("at") + insample + oos - 1).alias("pos")),
            )
        ).alias("e"),
    ).select("fold", "e.edge", "e.pos")
    named = edges.join(numbered, "pos")
    names = ["is_start", "is_end", "oos_start", "oos_end"]
    return named.groupBy("fold").pivot("edge", names).agg(F.first("ts")).select("fold", *names)


def rows_in_windows(rows: DataFrame, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Join every row to the windows that contain its date, both ends included.

    The boundaries of all windows, in order, cut the calendar into pieces; a window lists its first boundary and the one after its
    end, and the pieces between them.  Each day belongs to one piece and is listed once, however many windows there are, so
    rows find their piece and the piece its windows by equal keys.  A window without one of its ends, or that ends before it
    starts, contains nothing.
    """
    listed = windows.filter(F.col(start) <= F.col(end)).withColumn("_after", F.date_add(end, 1))
    days = listed.select(F.explode(F.array(F.col(start).cast("date"), "_after")).alias("_day")).distinct()
    # At most two rows per window, and one per day of the calendar.
    order = Window.orderBy("_day")
    edges = days.select("_day", F.row_number().over(order).alias("_piece"), F.date_sub(F.lead("_day").over(order), 1).alias("_until"))
    calendar = edges.filter("_until is not null").select("_piece", F.explode(F.sequence("_day", "_until")).alias("ts"))
    first = edges.select(F.col("_day").alias(start), F.col("_piece").alias("_from"))
    after = edges.select(F.col("_day").alias("_after"), F.col("_piece").alias("_to"))
    pieces = F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_piece")
    active = listed.join(first, start).join(after, "_after").select(*windows.columns, pieces)
    return rows.join(calendar, "ts").join(active, "_piece").select(*rows.columns, *windows.columns)


def split_by_fold(prices: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Prices of every fold, from the start of its in-sample to the end of its out-of-sample window."""
    return rows_in_windows(prices, fold_rows, "is_start", "oos_end")


def phases(nav: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Tag the NAV rows of each run with the fold's phase, ``IS`` or ``OOS``; ``nav`` carries ``fold``."""
    phase = (
        F.when(F.col("ts").between(F.col("is_start"), F.col("is_end")), "IS")
        .when(F.col("ts").between(F.col("oos_start"), F.col("oos_end")), "OOS")
    )
    tagged = nav.join(fold_rows, "fold").withColumn("phase", phase)
    return tagged.filter("phase is not null").select("run_id", "fold", "phase", "ts", "nav")


def phase_summaries(nav: DataFrame, fold_rows: DataFrame) -> DataFrame:
    return performance_summary(phases(nav, fold_rows), by=("run_id", "fold", "phase"))


def walk_forward_summary(nav: DataFrame, fold_rows: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """One row per run and fold: dates, ``is_*`` and ``oos_*`` metrics and those of the whole run."""
    by_phase = phase_summaries(nav, fold_rows).groupBy("run_id", "fold").pivot("phase", ["IS", "OOS"])
    wide = by_phase.agg(*[F.first(m).alias(m) for m in METRICS])
    renamed = wide.select(
        "run_id",
        "fold",
        *[F.col(f"IS_{m}").alias(f"is_{m}") for m in METRICS],
        *[F.col(f"OOS_{m}").alias(f"oos_{m}") for m in METRICS],
    )
    overall = performance_summary(nav, trades)
    return fold_rows.join(renamed, "fold").join(overall, "run_id")
