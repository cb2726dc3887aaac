"""Orders and capacity-limited fills from target positions.

The input is the *book*: one row per ``(run_id, symbol, ts)`` session with ``symbol_pos`` (order of
the instrument in the universe), ``close``, ``adv``, ``point_value`` and ``target``, plus the cost
parameters of the run (see :data:`COST_COLUMNS`).

What a day-by-day event loop would produce follows from running sums.  A target set on day ``t`` is
ordered at that close and filled from the next session on, first in first out, up to the daily
capacity.  On the axis of cumulative traded volume, order ``k`` covers one interval and session
``t`` serves one interval; merging both sets of interval ends and sorting them yields every fill as
one elementary piece.  That is a sort per series, not a join of orders with days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import commission, participation_slippage
from ..functions.series import exact_sum, series, upto

KEYS = ("run_id", "symbol")
COST_COLUMNS = ("adv_limit_pct", "commission_per_contract", "impact_k", "impact_alpha", "tick_value", "min_slippage_ticks")

_MIN_ORDER = 1e-8
_MIN_FILL = 1e-9
_QTY = "decimal(28,9)"  # exact running volumes: sums of doubles would blur where intervals meet
_VOLUME = "decimal(38,9)"


def hand_off(targets: DataFrame) -> DataFrame:
    """Add ``desired``: yesterday's target, which is what today's position works towards."""
    return targets.withColumn("desired", F.lag("target", 1, 0.0).over(series(KEYS)))


def rebalance_deltas(book: DataFrame) -> DataFrame:
    """Add ``delta``: the order quantity submitted at each close (0 on the last session).

    Position plus pending orders always equals the previous target, so the order is the change of
    the target.
    """
    w = series(KEYS)
    change = F.col("target") - F.lag("target", 1, 0.0).over(w)
    live = F.lead("ts").over(w).isNotNull() & (F.abs(change) > _MIN_ORDER)
    return book.withColumn("delta", F.when(live, change).otherwise(0.0))


def rebalance_orders(book: DataFrame) -> DataFrame:
    rows = rebalance_deltas(book).filter("delta <> 0")
    return rows.select(
        *KEYS, "symbol_pos", F.col("ts").alias("submitted"), F.lit(2).alias("leg"),
        F.col("delta").alias("qty"), F.lit("rebalance").alias("reason"), "target",
    )


def number_orders(orders: DataFrame) -> DataFrame:
    """Add ``order_id``: 1, 2, ... per run by day, rolls before rebalances, then instrument and leg.

    Rank inside the day plus a running total of the days before, so no task sorts a whole run.
    """
    day = Window.partitionBy("run_id", "submitted")
    rank = F.row_number().over(day.orderBy(F.col("leg") == 2, "symbol_pos", "leg"))
    before = Window.partitionBy("run_id").orderBy("submitted").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        orders.groupBy("run_id", "submitted")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = orders.withColumn("_rank", rank).join(offsets, ["run_id", "submitted"])
    return ranked.withColumn("order_id", F.col("_offset") + F.col("_rank")).drop("_offset", "_rank")


def daily_capacity(adv: Column, adv_limit_pct: Column) -> Column:
    """Contracts that may trade in a session; null means unlimited."""
    return F.when(adv_limit_pct > 0, F.greatest(adv_limit_pct * adv, F.lit(0.0)))


def _with_legs(book: DataFrame, roll_dates: DataFrame | None) -> DataFrame:
    """Rebalance delta and roll size per session, the roll taken at the uncapped position."""
    rows = rebalance_deltas(book)
    if roll_dates is None:
        return rows.withColumn("roll_qty", F.lit(0.0)).withColumn("_due", F.lit(False))
    marked = rows.join(
        roll_dates.select("symbol", "ts").distinct().withColumn("_roll", F.lit(True)), ["symbol", "ts"], "left"
    )
    held = F.lag("target", 1, 0.0).over(series(KEYS))
    marked = marked.withColumn("_due", F.coalesce(F.col("_roll") & F.lead("ts").over(series(KEYS)).isNotNull(), F.lit(False)))
    return marked.withColumn("roll_qty", F.when(F.col("_due") & (F.abs(held) > _MIN_ORDER), held).otherwise(0.0)).drop("_roll")


def service_curve(book: DataFrame, roll_dates: DataFrame | None = None) -> DataFrame:
    """Add the cumulative volume ``arrived`` before and ``served`` by the end of each session.

    With daily capacity ``c`` and its running sum ``C``, ``served = C + min(0, min(arrived - C))``.
    """
    return _served(_with_legs(book, roll_dates))


def _served(rows: DataFrame) -> DataFrame:
    volume = (F.abs("delta") + 2 * F.abs("roll_qty")).cast(_QTY)
    earlier = series(KEYS).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_vol", volume)
    rows = rows.withColumn(
        "arrived", F.coalesce(F.sum("_vol").over(earlier), F.lit(0)).cast(_VOLUME)
    ).drop("_vol")
    # A session never serves more than has arrived, which also keeps the running sum small.
    cap = daily_capacity(F.col("adv"), F.col("adv_limit_pct")).cast(_QTY)
    rows = rows.withColumn("_cap", F.least(cap, F.col("arrived").cast(_QTY)))
    rows = rows.withColumn("_C", F.sum("_cap").over(upto(KEYS)).cast(_VOLUME))
    slack = F.min(F.col("arrived") - F.col("_C")).over(upto(KEYS))
    served = F.col("_C") + F.least(slack, F.lit(0).cast(_VOLUME))
    unlimited = F.col("adv_limit_pct").isNull() | (F.col("adv_limit_pct") <= 0)
    rows = rows.withColumn("served", F.when(unlimited, F.col("arrived")).otherwise(served).cast(_VOLUME))
    return rows.drop("_cap", "_C")


def _pieces(rows: DataFrame) -> DataFrame:
    """Every fill as the piece of volume between two neighbouring interval ends of one series."""
    base = F.col("arrived")
    roll, delta = F.col("roll_qty"), F.col("delta")
    roll_vol = F.abs(roll).cast(_QTY)

    def end(volume: Column) -> Column:
        return volume.cast(_VOLUME)

    def order(leg: int, qty: Column, until: Column, reason: str, target: Column) -> Column:
        return F.struct(
            F.col("ts").alias("submitted"), F.lit(leg).alias("leg"), qty.alias("qty"),
            end(until).alias("until"), F.lit(reason).alias("reason"), target.alias("target"),
        )

    no_target = F.lit(None).cast("double")
    day = F.struct("ts", "close", "adv", "point_value", *COST_COLUMNS)
    no_day, no_order = F.lit(None), F.lit(None)

    def mark(volume: Column, day_part: Column, order_part: Column) -> Column:
        return F.struct(volume.alias("v"), F.col("ts").alias("at"), day_part.alias("day"), order_part.alias("ord"))

    orders = [
        (roll != 0, order(0, -roll, base + roll_vol, "roll", no_target)),
        (roll != 0, order(1, roll, base + 2 * roll_vol, "roll", no_target)),
        (delta != 0, order(2, delta, base + 2 * roll_vol + F.abs(delta).cast(_QTY), "rebalance", F.col("target"))),
    ]
    marks = [mark(F.col("served"), day, no_order)]
    marks += [F.when(live, mark(o["until"], no_day, o)) for live, o in orders]
    ends = rows.select(*KEYS, "symbol_pos", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    ends = ends.select(*KEYS, "symbol_pos", "m.*")

    # Read from the far end: the nearest order and session at or beyond a point are then the last seen.
    back = Window.partitionBy(*KEYS).orderBy(F.col("v").desc(), F.col("at").desc())
    seen = back.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(
        *KEYS, "symbol_pos", "v",
        (F.col("v") - F.coalesce(F.lead("v").over(back), F.lit(0))).cast("double").alias("size"),
        F.last("day", ignorenulls=True).over(seen).alias("day"),
        F.last("ord", ignorenulls=True).over(seen).alias("ord"),
    )
    pieces = pieces.filter((F.col("size") > _MIN_FILL) & F.col("day").isNotNull() & F.col("ord").isNotNull())
    return pieces.select(
        *KEYS, "symbol_pos", "day.*", "ord.submitted", "ord.leg", "ord.reason",
        (F.signum("ord.qty") * F.col("size")).alias("qty"),
        ((F.col("ord.until") - F.col("v")).cast("double") > _MIN_FILL).alias("partial"),
    )


def _rolls_under_capacity(table: pa.Table) -> pa.Table:
    """One series with the sizes of its rolls (``roll_qty``) as they are when capacity binds; all other columns as they are.

    On the axis of cumulative volume, the position after serving v is a broken line: an order moves it by its own
    quantity, and the two legs of a roll take it to nothing and back. What is served by the end of session t obeys
    ``S(t) = min(A(t-1), S(t-1) + c(t))``, so from one roll day r to the next one s it is
    ``min(S(r) + C(r, s], A(r) + min over j of D(r, j-1] + C(j, s])``, with C and D the running sums of capacity and of
    rebalance volume: a shift and a floor. A roll's size is the line's value at S(s), and puts two more knots on it. The
    loop is over the rolls, everything between two of them is one array expression.
    """
    table = table.sort_by("ts")
    numbers = lambda name: np.nan_to_num(table.column(name).to_numpy(zero_copy_only=False).astype(float))
    delta, sizes = numbers("delta"), np.zeros(table.num_rows)
    limit = numbers("adv_limit_pct")
    cap = np.where(limit > 0, np.maximum(limit * numbers("adv"), 0.0), np.inf)
    goal = np.cumsum(delta)
    due = np.flatnonzero(table.column("_due").to_numpy(zero_copy_only=False).astype(bool))
    axis, line = np.zeros(1), np.zeros(1)  # knots of the broken line that are not yet served, and the last one that is
    served = arrived = 0.0
    last = 0  # the session up to which `served` is known; the orders of its close and later are not on the axis
    for day in due[due > 0].tolist():
        ends = arrived + np.cumsum(np.abs(delta[last:day]))
        room = np.append(np.cumsum(cap[last + 2 : day + 1][::-1])[::-1], 0.0)
        served = min(served + cap[last + 1 : day + 1].sum(), float((ends + room).min()))
        axis, line = np.append(axis, ends), np.append(line, goal[last:day])
        arrived, size = float(ends[-1]), round(float(np.interp(served, axis, line)), 9)
        below = int(np.searchsorted(axis, served, side="right")) - 1
        axis, line = axis[below:], line[below:]
        if abs(size) > _MIN_ORDER:
            sizes[day] = size
            axis, line = np.append(axis, arrived + abs(size) * np.array([1, 2])), np.append(line, goal[day - 1] - np.array([size, 0]))
            arrived += 2 * abs(size)
        last = day
    return table.set_column(table.column_names.index("roll_qty"), "roll_qty", pa.array(sizes))


def _priced(fills: DataFrame) -> DataFrame:
    notional = F.col("qty") * F.col("close") * F.col("point_value")
    slip = participation_slippage(
        F.col("qty"), F.col("adv"), k=F.col("impact_k"), alpha=F.col("impact_alpha"),
        tick_value=F.col("tick_value"), min_ticks=F.col("min_slippage_ticks"),
    )
    fee = commission(F.col("qty"), F.col("commission_per_contract"))
    return fills.select(
        "run_id", "ts", "symbol", "symbol_pos", "qty", F.col("close").alias("price"),
        notional.alias("notional"), slip.alias("slippage"), fee.alias("commission"),
        (fee + slip).alias("cost"), "reason", "submitted", "leg", "partial",
    )


def events(book: DataFrame, roll_dates: DataFrame | None = None) -> DataFrame:
    """Orders (``kind`` o) and fills (f) of the whole book in one table, still without order ids.

    A roll has the size of the position, which is the last target unless capacity holds orders back. Where rolls meet a
    binding capacity, their sizes are found first, series by series; all else is expressions.
    """
    curve = service_curve(book, roll_dates)
    legs = [F.when(F.col("delta") != 0, _leg(2, F.col("delta"), "rebalance", F.col("target")))]
    if roll_dates is not None:
        whole = Window.partitionBy(*KEYS)
        late = F.max(F.col("arrived") - F.col("served")).over(whole) > 0
        curve = curve.withColumn("_late", late & F.max("_due").over(whole))
        sized = curve.filter("_late").drop("arrived", "served", "_late")
        sized = sized.groupBy(*KEYS).applyInArrow(_rolls_under_capacity, sized.schema)
        curve = curve.filter("not _late").drop("_late").unionByName(_served(sized))
        live = F.col("roll_qty") != 0
        legs += [F.when(live, _leg(k, sign * F.col("roll_qty"), "roll", None)) for k, sign in ((0, -1), (1, 1))]
    orders = curve.select(
        *KEYS, "symbol_pos", F.col("ts").alias("submitted"), F.explode(F.filter(F.array(*legs), lambda x: x.isNotNull())).alias("l")
    ).select(F.lit("o").alias("kind"), *KEYS, "symbol_pos", "submitted", "l.*")
    return orders.unionByName(_pieces(curve).withColumn("kind", F.lit("f")), allowMissingColumns=True)


def orders_and_fills(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two kinds of :func:`events`; fills with their price and costs."""
    orders = table.filter("kind = 'o'").select(*KEYS, "symbol_pos", "submitted", "leg", "qty", "reason", "target")
    return orders, _priced(table.filter("kind = 'f'"))


def execute(book: DataFrame, roll_dates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(orders, fills)`` of the whole book, still without order ids (see :func:`trade_log`)."""
    return orders_and_fills(events(book, roll_dates))


def _leg(leg: int, qty: Column, reason: str, target: Column | None) -> Column:
    return F.struct(
        F.lit(leg).alias("leg"), qty.alias("qty"), F.lit(reason).alias("reason"),
        (F.lit(None).cast("double") if target is None else target).alias("target"),
    )


def with_order_ids(fills: DataFrame, numbered: DataFrame) -> DataFrame:
    """Give every fill the ``order_id`` of its order."""
    ids = numbered.select(*KEYS, "submitted", "leg", "order_id")
    return fills.join(ids, [*KEYS, "submitted", "leg"])


def trade_log(orders: DataFrame, fills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the orders and the fills."""
    numbered = number_orders(orders)
    return numbered, with_order_ids(fills, numbered)


def positions_from_fills(book: DataFrame, fills: DataFrame) -> DataFrame:
    """Dense ``pos`` per session: running sum of the fills."""
    daily = fills.groupBy(*KEYS, "ts").agg(exact_sum("qty").alias("_qty"))
    rows = book.join(daily, [*KEYS, "ts"], "left")
    held = F.sum(F.coalesce("_qty", F.lit(0.0))).over(upto(KEYS))
    return rows.withColumn("pos", held).drop("_qty")


def cash_after_fills(fills: DataFrame, starting_nav: Column | float = 1_000_000.0) -> DataFrame:
    """Add ``cash_after``, running per fill: by day, then instrument order, then queue order.

    Cash at the start of a day is a running sum over daily totals; only the fills of one day are
    sorted together.
    """
    spent = F.col("notional") + F.col("cost")
    before = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        fills.groupBy("run_id", "ts")
        .agg(exact_sum(spent).alias("_day"))
        .withColumn("_spent_before", F.coalesce(F.sum("_day").over(before), F.lit(0.0)))
        .drop("_day")
    )
    inside = (
        Window.partitionBy("run_id", "ts")
        .orderBy("symbol_pos", "order_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = fills.withColumn("_spent_day", F.sum(spent).over(inside)).join(opening, ["run_id", "ts"])
    start = starting_nav if isinstance(starting_nav, Column) else F.lit(float(starting_nav))
    cash = start - F.col("_spent_before") - F.col("_spent_day")
    return rows.withColumn("cash_after", cash).drop("_spent_before", "_spent_day")
