"""Orders, fills and ledger against golden numbers and a day-by-day loop."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from trendlab.functions.costs import notional_slippage
from trendlab.operators import attribution, execution, ledger

SCHEMA = """run_id string, symbol string, symbol_pos int, ts date, close double, adv double, point_value double, target double,
    adv_limit_pct double, commission_per_contract double, impact_k double, impact_alpha double, tick_value double, min_slippage_ticks double"""


def make_book(spark, days, series, *, pct=1.0, fee=0.0, k=0.0, alpha=1.0, tick=1.0, floor=0.0, run="r"):
    """``series``: symbol -> (targets, closes, advs)."""
    rows = [
        (run, s, pos, d, float(c), float(a), 1.0, float(t), pct, fee, k, alpha, tick, floor)
        for pos, (s, (targets, closes, advs)) in enumerate(series.items())
        for d, t, c, a in zip(days, targets, closes, advs, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_capped_fills_golden(spark, weekdays):
    days = weekdays("2024-01-01", 5)
    book = make_book(spark, days, {"ES": ([6, 6, 0, 0, 0], range(100, 105), [3] * 5)})
    orders, fills = execution.trade_log(*execution.execute(book))
    rows = fills.orderBy("ts", "order_id").collect()
    assert [r.qty for r in rows] == [3, 3, -3, -3]
    assert [r.partial for r in rows] == [True, False, True, False]
    book_value = ledger.ledger(execution.positions_from_fills(book, fills), fills).orderBy("ts").collect()
    assert book_value[0].nav == 1_000_000 and book_value[-1].nav == book_value[-1].cash == 1_000_012
    assert sum(r.total_cost for r in book_value) == 0
    assert max(abs(r.nav - r.cash - r.asset_value) for r in book_value) <= 1e-6


def test_roll_costs_golden(spark, weekdays):
    days = weekdays("2024-02-01", 5)
    book = make_book(spark, days, {"ES": ([2, 2, 2, 0, 0], range(100, 105), [10] * 5)}, fee=1.0)
    rolls = spark.createDataFrame([("ES", days[2])], "symbol string, ts date")
    orders, fills = execution.trade_log(*execution.execute(book, rolls))
    legs = fills.filter("reason = 'roll'").collect()
    assert sorted(r.qty for r in legs) == [-2, 2] and {r.ts for r in legs} == {days[3]}
    costs = {r.ts: r for r in ledger.daily_costs(fills).collect()}
    assert costs[days[3]].roll_cost == 4 and costs[days[3]].trading_cost == 0
    assert orders.filter("reason = 'roll'").count() == 2


def loop(days, series, pct, rolls):
    """One queue per instrument, walked day by day."""
    orders, fills, count = [], [], 0
    queues = {s: deque() for s in series}
    held = dict.fromkeys(series, 0.0)

    def submit(i, s, qty, reason):
        nonlocal count
        if abs(qty) <= 1e-8:
            return
        count += 1
        orders.append((count, days[i], s, qty, reason))
        queues[s].append([count, qty, reason])

    def rebalance(i):
        for s, (targets, _, _) in series.items():
            submit(i, s, targets[i] - held[s] - sum(o[1] for o in queues[s]), "rebalance")

    rebalance(0)
    for i in range(1, len(days)):
        for s, (_, _, advs) in series.items():
            room = pct * advs[i] if pct > 0 else float("inf")
            while queues[s] and room > 1e-12:
                order = queues[s][0]
                part = min(abs(order[1]), room) * (1 if order[1] > 0 else -1)
                order[1] -= part
                room -= abs(part)
                held[s] += part
                open_part = abs(order[1]) > 1e-9
                fills.append((days[i], s, order[0], part, order[2], open_part))
                if open_part:
                    break
                queues[s].popleft()
        if i + 1 < len(days):
            for s in series:
                if (s, days[i]) in rolls and abs(held[s]) > 1e-8:
                    size = held[s]
                    submit(i, s, -size, "roll")
                    submit(i, s, size, "roll")
            rebalance(i)
    return orders, fills


@pytest.mark.parametrize("with_rolls", [False, True])
@pytest.mark.parametrize("pct", [0.0, 0.3, 1.0, 100.0])
def test_fills_match_the_loop(spark, weekdays, pct, with_rolls):
    rng = random.Random(int(pct * 10) + with_rolls)
    days = weekdays("2024-01-01", 60)
    series = {}
    for s in ("A", "B", "C"):
        targets, now = [], 0
        for _ in days:
            now = rng.choice([now, now, rng.randint(-12, 12)])
            targets.append(now)
        series[s] = (targets, [rng.uniform(50, 150) for _ in days], [rng.choice([0, 1, 2, 5, 9]) for _ in days])
    rolls = {(s, days[i]) for s in series for i in range(0, 60, 7)} if with_rolls else set()
    table = spark.createDataFrame(sorted(rolls), "symbol string, ts date") if with_rolls else None
    book = make_book(spark, days, series, pct=pct, fee=1.0, k=0.05, alpha=0.5, tick=10.0)
    orders, fills = execution.trade_log(*execution.execute(book, table))
    want_orders, want_fills = loop(days, series, pct, rolls)
    got_orders = sorted((r.order_id, r.submitted, r.symbol, r.qty, r.reason) for r in orders.collect())
    assert [(o[0], o[1], o[2], o[4]) for o in got_orders] == [(o[0], o[1], o[2], o[4]) for o in want_orders]
    assert [o[3] for o in got_orders] == pytest.approx([o[3] for o in want_orders])
    got = sorted((r.ts, r.symbol, r.order_id, r.qty, r.reason, r.partial) for r in fills.collect())
    want = sorted(want_fills)
    assert [(g[0], g[1], g[2], g[4], g[5]) for g in got] == [(w[0], w[1], w[2], w[4], w[5]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])

    # cash per fill runs by day, instrument and queue; NAV moves by contributions less costs
    cash, expected = 1_000_000.0, {}
    by_key = {(r.ts, r.symbol, r.order_id): r for r in fills.collect()}
    for day, s, order_id, *_ in sorted(want_fills, key=lambda w: (w[0], w[1], w[2])):
        row = by_key[day, s, order_id]
        cash -= row.notional + row.cost
        expected[day, s, order_id] = cash
    after = {(r.ts, r.symbol, r.order_id): r.cash_after for r in execution.cash_after_fills(fills).collect()}
    assert after == pytest.approx(expected)
    positions = execution.positions_from_fills(book, fills)
    rows = ledger.ledger(positions, fills)
    assert ledger.identity_violations(rows, attribution.pnl_contributions(positions)).count() == 0


def test_rolls_that_meet_a_backlog_of_earlier_rolls(spark, weekdays):
    """A roll on nearly every session under a capacity that never clears the queue."""
    rng = random.Random(11)
    days = weekdays("2024-01-01", 45)
    series = {
        s: ([rng.randint(-9, 9) for _ in days], [100.0] * 45, [rng.choice([0, 1, 3, 40]) for _ in days]) for s in ("A", "B", "C", "D")
    }
    rolls = {(s, d) for s in series for d in days if rng.random() < 0.6}
    table = spark.createDataFrame(sorted(rolls), "symbol string, ts date")
    orders, fills = execution.trade_log(*execution.execute(make_book(spark, days, series, pct=0.5), table))
    want_orders, want_fills = loop(days, series, 0.5, rolls)
    got = sorted((r.order_id, r.submitted, r.symbol, r.reason, round(r.qty, 6)) for r in orders.collect())
    assert got == [(o[0], o[1], o[2], o[4], round(o[3], 6)) for o in want_orders]
    filled = sorted((r.ts, r.symbol, r.order_id, round(r.qty, 6), r.reason, r.partial) for r in fills.collect())
    assert filled == [(*w[:3], round(w[3], 6), *w[4:]) for w in sorted(want_fills)]


def test_notional_slippage_floor(spark):
    rows = spark.createDataFrame([(0.0,), (1_000_000.0,), (-4_000_000.0,)], "n double")
    assert [r[0] for r in rows.select(notional_slippage(F.col("n"))).collect()] == [5.0, 50.0, 100.0]
