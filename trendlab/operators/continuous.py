"""Continuous futures series from contract-month prices and a roll schedule.

``contract_prices(contract, ts, price)`` and ``schedule(root, start_ts, contract)``.  Segment ``k``
of a root is the half-open interval from its start to the next start.  What links two segments is
one number per roll, so the adjustments are running sums or products over the handful of schedule
rows of a root, joined back to the daily rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ratio
from ..sources.sinks import stored

METHODS = ("back_adjusted", "ratio_adjusted", "stitched")
_ALIASES = {"stitch_returns": "stitched"}


def intervals(schedule: DataFrame) -> DataFrame:
    """Number the segments and give each its exclusive end (null for the last one)."""
    by_start = Window.partitionBy("root").orderBy("start_ts")
    days = schedule.select("root", F.col("start_ts").cast("date").alias("start_ts"), "contract")
    return days.select(
        "root",
        (F.row_number().over(by_start) - 1).alias("k"),
        "start_ts",
        F.lead("start_ts").over(by_start).alias("end_ts"),
        "contract",
        F.lead("contract").over(by_start).alias("next_contract"),
    )


def front_prices(contract_prices: DataFrame, schedule: DataFrame) -> DataFrame:
    """Unadjusted front contract: prices of each segment's contract inside its interval."""
    rows = _tagged(contract_prices, schedule).filter("contract = front")
    return rows.select("root", "k", "contract", "ts", "price")


def _tagged(contract_prices: DataFrame, schedule: DataFrame) -> DataFrame:
    """All contract prices of a root, each with the segment that is in front on that date.

    Segment starts are merged into the root's rows and carried forward, so a date finds its segment
    in one ordered pass instead of being compared with every interval.
    """
    seg = intervals(schedule)
    roster = seg.select("root", "contract").distinct()
    quotes = contract_prices.join(roster, "contract").select(
        "root", "ts", F.lit(1).alias("_kind"), "contract", "price", F.lit(None).alias("_seg")
    )
    marks = seg.select(
        "root",
        F.col("start_ts").alias("ts"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("string").alias("contract"),
        F.lit(None).cast("double").alias("price"),
        F.struct("k", F.col("contract").alias("front"), F.col("next_contract").alias("next")).alias("_seg"),
    )
    # Starts on the same day follow each other in segment order; the latest one wins.
    order = Window.partitionBy("root").orderBy("ts", "_kind", F.col("_seg.k"))
    carried = F.last("_seg", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = quotes.unionByName(marks, allowMissingColumns=False).withColumn("_seg", carried)
    return rows.filter("_kind = 1 and _seg is not null").select(
        "root", "ts", "contract", "price", "_seg.k", "_seg.front", "_seg.next"
    )


def _boundaries(tagged: DataFrame) -> DataFrame:
    """One row per non-empty segment: its first and last front quote, its last session, and the link to the next contract.

    The link is the last session of the segment on which the front and the next contract are both quoted.
    """
    quote = lambda name: F.max(F.when(F.col("contract") == F.col(name), F.col("price")))
    daily = tagged.groupBy("root", "k", "ts").agg(quote("front").alias("front"), quote("next").alias("next"))
    quoted = F.when(F.col("front").isNotNull(), F.struct("ts", "front"))
    both = F.when(F.col("front").isNotNull() & F.col("next").isNotNull(), F.struct("ts", "front", "next"))
    return daily.groupBy("root", "k").agg(
        F.min(quoted)["front"].alias("first_price"),
        F.max(quoted)["front"].alias("last_price"),
        F.max("ts").alias("last_ts"),
        F.max(both).alias("link"),
    )


def _earlier_links(contract_prices: DataFrame, unlinked: DataFrame) -> DataFrame:
    """``(root, k, link)``: the last session before its start on which a segment's contract and the next one are both quoted."""
    quotes = contract_prices.filter("price is not null")
    of = lambda name: quotes.select(F.col("contract").alias(name), "ts", F.col("price").alias(f"{name}_price"))
    both = unlinked.join(of("contract"), "contract").filter("ts < start_ts").join(of("next_contract"), ["next_contract", "ts"])
    link = F.struct("ts", F.col("contract_price").alias("front"), F.col("next_contract_price").alias("next"))
    return both.groupBy("root", "k").agg(F.max(link).alias("earlier"))


def roll_links(contract_prices: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per segment with sessions: what ties it to the next one.

    ``(root, k, contract, next_contract, start_ts, end_ts, first_price, last_price, link_ts, link_price, next_price, gap_days)``.
    The contracts are compared on the last session before the roll on which both are quoted, inside the segment or, where it has
    none, before it; ``gap_days`` is how long before the segment's last session that was. Without any such session
    the link is null. The rows are few, and written once, as checks and adjustments both read them.
    """
    seg = intervals(schedule)
    tagged = _tagged(contract_prices, schedule)
    bounds = stored(_boundaries(tagged).join(seg, ["root", "k"]), "roll-bounds")
    unlinked = bounds.filter("link is null and next_contract is not null")
    if not unlinked.isEmpty():
        earlier = _earlier_links(contract_prices, unlinked.select("root", "k", "contract", "next_contract", "start_ts"))
        bounds = stored(bounds.join(earlier, ["root", "k"], "left").withColumn("link", F.coalesce("link", "earlier")).drop("earlier"), "roll-links")
    return bounds.select(
        "root", "k", "contract", "next_contract", "start_ts", "end_ts", "first_price", "last_price",
        F.col("link.ts").alias("link_ts"), F.col("link.front").alias("link_price"), F.col("link.next").alias("next_price"),
        F.datediff("last_ts", "link.ts").alias("gap_days"),
    )


def _adjustments(links: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``(root, k, <method>...)``: offset or factor per segment; null once a link is missing.

    Stitching ties the first quote of a segment to the last one before it, so a segment without quotes is passed over.
    """
    by_root = Window.partitionBy("root").orderBy("k")
    upto = by_root.rowsBetween(Window.unboundedPreceding, 0)
    last, following, first = F.col("link_price"), F.col("next_price"), F.col("first_price")
    before = F.last("last_price", ignorenulls=True).over(by_root.rowsBetween(Window.unboundedPreceding, -1))
    steps = {
        "back_adjusted": F.lag(last - following).over(by_root),
        "ratio_adjusted": F.lag(ratio(last, following)).over(by_root),
        "stitched": F.when(first.isNull() | before.isNull(), 1.0).otherwise(ratio(before, first)),
    }
    opening = F.row_number().over(by_root) == 1
    rows = links
    for name in methods:
        neutral = 0.0 if name == "back_adjusted" else 1.0
        rows = rows.withColumn(f"_{name}", F.when(opening, neutral).otherwise(steps[name]))
    adjusted = []
    for name in methods:
        combine = F.sum if name == "back_adjusted" else F.product
        broken = F.max(F.col(f"_{name}").isNull()).over(upto)
        adjusted.append(F.when(~broken, combine(f"_{name}").over(upto)).alias(name))
    return rows.select("root", "k", *adjusted)


def link_violations(
    contract_prices: DataFrame,
    schedule: DataFrame,
    methods: Sequence[str] = METHODS,
    max_gap_days: int | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """``(root, contract, problem)``: what ends a continuous series early, or ties it over too long a gap.

    A contract of the schedule without any price; a roll before which the two contracts were never quoted together, or
    not within ``max_gap_days`` of the segment's last session; a roll at which a ratio or stitched link divides by zero.
    """
    links = roll_links(contract_prices, schedule) if links is None else links
    known = contract_prices.filter("price is not null").select("contract").distinct()
    unknown = intervals(schedule).join(known, "contract", "left_anti").select("root", "contract", F.lit("no prices").alias("problem")).distinct()
    by_root = Window.partitionBy("root")
    edges = links.withColumn("_first", F.min("k").over(by_root)).withColumn("_last", F.max("k").over(by_root))
    rolls = edges.filter("k < _last")
    incoming = lambda rows, problem: rows.select("root", F.col("next_contract").alias("contract"), F.lit(problem).alias("problem"))
    found = [unknown]
    if {"back_adjusted", "ratio_adjusted"} & set(methods):
        apart = rolls.filter("link_ts is null").join(known, "contract", "left_semi")
        apart = apart.join(known.withColumnRenamed("contract", "next_contract"), "next_contract", "left_semi")
        found.append(incoming(apart, "no common quote before its roll"))
        if max_gap_days is not None:
            found.append(incoming(rolls.filter(F.col("gap_days") > max_gap_days), f"no common quote within {max_gap_days} days of its roll"))
    if "ratio_adjusted" in methods:
        found.append(incoming(rolls.filter("next_price = 0"), "zero price before its roll"))
    if "stitched" in methods:
        zero = edges.filter("first_price = 0 and k > _first").select("root", "contract")
        found.append(zero.withColumn("problem", F.lit("zero price after its roll")))
    return reduce(DataFrame.unionByName, found)


def continuous_matrix(
    contract_prices: DataFrame,
    schedule: DataFrame,
    methods: Sequence[str] = METHODS,
    check: bool = True,
    max_gap_days: int | None = None,
) -> DataFrame:
    """``(method, root, ts, price)`` for every root of the schedule at once.

    All methods share the segments and their links (:func:`roll_links`) and differ only in the step between two of them.
    A roll on a session without quotes is linked on the last session with both. An empty schedule and any
    :func:`link_violations` raise; with ``check=False`` a series ends at such a link.
    """
    methods = [_ALIASES.get(m, m) for m in methods]
    unknown = sorted(set(methods) - set(METHODS))
    if unknown:
        raise ValueError(f"no continuous series by {unknown}; known are {METHODS}")
    links = roll_links(contract_prices, schedule)
    if check:
        if links.isEmpty() and schedule.isEmpty():
            raise ValueError("a continuous series needs at least one row of roll schedule")
        if problem := link_violations(contract_prices, schedule, methods, max_gap_days, links).limit(1).collect():
            raise ValueError(f"continuous series would end early: {problem[0].asDict()}")
    front = _tagged(contract_prices, schedule).filter("contract = front and price is not null").join(_adjustments(links, methods), ["root", "k"])
    price = F.col("price")
    variants = [
        F.struct(F.lit(m).alias("method"), (price + F.col(m) if m == "back_adjusted" else price * F.col(m)).alias("price"))
        for m in methods
    ]
    out = front.select("root", "ts", F.explode(F.array(*variants)).alias("_v"))
    return out.select("_v.method", "root", "ts", "_v.price").filter("price is not null")


def continuous_series(
    contract_prices: DataFrame, schedule: DataFrame, method: str = "back_adjusted", check: bool = True, max_gap_days: int | None = None
) -> DataFrame:
    """``(root, ts, price)`` by one method."""
    return continuous_matrix(contract_prices, schedule, [method], check, max_gap_days).drop("method")
