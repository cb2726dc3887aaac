"""The whole backtest as SQL common table expressions, for any set of runs over the type panel."""

from __future__ import annotations

from collections.abc import Sequence

from . import panel

_UNI = "uni as (select * from (values " + ", ".join(
    f"('{s}', '{sector}', {pv!r}::double, {pos})" for pos, (s, sector, pv) in enumerate(panel.INSTRUMENTS)
) + ") t(symbol, sector, pv, pos))"

_RUN_COLUMNS = (
    "run_id, fold, w_start, w_end, nav0, lookbacks, skip, target_vol, gross, thr, alloc, max_w, caps, vol_model, vol_lb, lam, minp, "
    "comm, k, alpha, tick, mint, advp, adv0"
)


def _literal(value) -> str:
    if value is None:
        return "null::double"
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, dict):
        keys, vals = [f"'{k}'" for k in value], [f"{v!r}::double" for v in value.values()]
        return f"map([{', '.join(keys)}], [{', '.join(vals)}])"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(str(v) for v in value) + "]"
    if isinstance(value, float):
        return f"{value!r}::double"
    return str(value) if isinstance(value, int) else f"date '{value}'"


def runs_cte(rows: Sequence[dict], name: str = "runs") -> str:
    """Typed scenario rows as a table of literals."""
    fields = ("run_id", "fold", "start", "end", "starting_nav", "lookbacks", "skip_last_n", "target_vol", "gross_limit",
              "rebalance_threshold", "risk_allocator", "max_weight", "sector_caps", "vol_model", "vol_lookback", "ewma_lambda",
              "min_vol_periods", "commission_per_contract", "impact_k", "impact_alpha", "tick_value", "min_slippage_ticks",
              "adv_limit_pct", "default_adv")
    values = ", ".join("(" + ", ".join(_literal(r[f]) for f in fields) + ")" for r in rows)
    return f"{name} as (select * from (values {values}) t({_RUN_COLUMNS}))"


def runs_per_fold(row: dict) -> list[str]:
    """One run per walk-forward fold (table ``folds``), otherwise the settings of ``row``."""
    return [
        runs_cte([row], "one"),
        """runs as (select 'run-' || lpad(cast(f.fold as varchar), 4, '0') as run_id, f.fold, f.is_start as w_start, f.oos_end as w_end,
          one.* exclude (run_id, fold, w_start, w_end) from one cross join folds f)""",
    ]


_BY = "partition by run_id, symbol order by i"

PANEL = f"""wgap as (
  select r.run_id, p.symbol, p.ts, last_value(p.close ignore nulls) over (partition by r.run_id, p.symbol order by p.ts rows unbounded preceding) as close
  from px p join runs r on p.ts between r.w_start and r.w_end),
wpx as (
  select g.run_id, g.symbol, g.ts, g.close, row_number() over (partition by g.run_id, g.symbol order by g.ts) - 1 as i
  from (select *, count(close) over (partition by run_id, ts) as c from wgap) g
  join (select run_id, count(distinct symbol) as n from wgap where close is not null group by 1) m on m.run_id = g.run_id and g.c = m.n),
hz as (
  select run_id, skip, lb, (1/sqrt(lb)) / sum(1/sqrt(lb)) over (partition by run_id) as w
  from (select run_id, skip, unnest(lookbacks) as lb from runs)),
mom as (
  select w.run_id, w.symbol, w.i, sum(coalesce((a.close / b.close - 1) * h.w, 0)) as raw
  from wpx w join hz h on h.run_id = w.run_id
  left join wpx a on a.run_id = w.run_id and a.symbol = w.symbol and a.i = w.i - h.skip
  left join wpx b on b.run_id = w.run_id and b.symbol = w.symbol and b.i = w.i - h.skip - h.lb
  group by 1, 2, 3),
sig as (select run_id, symbol, i, coalesce(lag(tanh(raw / 3.0)) over ({_BY}), 0) as signal from mom),
rets as (
  select w.run_id, w.symbol, w.i, r.lam, r.minp, r.vol_model, r.vol_lb,
    coalesce(w.close / lag(w.close) over (partition by w.run_id, w.symbol order by w.i) - 1, 0) as r0
  from wpx w join runs r on r.run_id = w.run_id),
ew as (
  select *, pow(lam, i) * sum(case when i = 0 then r0 else (1-lam) * r0 * pow(lam, -i) end) over w as m1,
    pow(lam, i) * sum(case when i = 0 then r0*r0 else (1-lam) * r0*r0 * pow(lam, -i) end) over w as m2,
    pow(lam, 2*i) + (1-lam)*(1-lam) * (1 - pow(lam, 2*i)) / (1 - lam*lam) as s,
    count(*) over wl as nl, stddev_pop(r0) over wl as sdl
  from rets window w as ({_BY} rows unbounded preceding), wl as ({_BY} rows between vol_lb - 1 preceding and current row)),
vraw as (
  select run_id, symbol, i, nullif(case when vol_model = 'ewma'
      then case when i + 1 >= minp and s < 1 then sqrt(greatest(m2 - m1*m1, 0) / (1 - s)) end
      else case when nl >= minp then sdl end end * sqrt(252), 0) as v from ew),
vol as (
  select run_id, symbol, i, coalesce(last_value(v ignore nulls) over ({_BY} rows unbounded preceding),
    first_value(v ignore nulls) over ({_BY} rows between current row and unbounded following), 0) as vol from vraw),
vols as (
  select w.run_id, w.symbol, w.i, coalesce(
      last_value(cast(b.volume as double) ignore nulls) over (partition by w.run_id, w.symbol order by w.i rows unbounded preceding),
      first_value(cast(b.volume as double) ignore nulls) over (partition by w.run_id, w.symbol order by w.i rows between current row and unbounded following)) as adv
  from wpx w left join bars b on b.symbol = w.symbol and b.ts = w.ts),
base as (
  select w.*, s.signal, v.vol, u.sector, u.pv, u.pos as symbol_pos, coalesce(a.adv, r.adv0) as adv, r.* exclude (run_id, fold, w_start, w_end)
  from wpx w join sig s using (run_id, symbol, i) join vol v using (run_id, symbol, i) join vols a using (run_id, symbol, i)
  join uni u using (symbol) join runs r using (run_id))"""

SIZING = """budgets as (
  select *, coalesce(case when alloc = 'proportional' then abs(signal) / nullif(sum(abs(signal)) over d, 0)
    else (abs(signal) > 0)::int / nullif(sum((abs(signal) > 0)::int) over d, 0) end, 0) as budget
  from base window d as (partition by run_id, ts)),
capped as (
  select * replace (case when total > caps[sector] then budget * caps[sector] / total else budget end as budget)
  from (select *, sum(budget) over (partition by run_id, ts, sector) as total from budgets)),
weights as (select *, coalesce(budget * target_vol / nullif(vol, 0), 0) * sign(signal) as w0 from capped),
clipped as (select *, case when max_w > 0 then greatest(-max_w, least(max_w, w0)) else w0 end as w1 from weights),
grossed as (
  select *, w1 * case when gross > 0 and g > gross then gross / g else 1 end as weight
  from (select *, sum(abs(w1)) over (partition by run_id, ts) as g from clipped)),
sized as (select *, coalesce(weight * nav0 / nullif(close * pv, 0), 0) as contracts from grossed)"""

BAND = """held as (
  select run_id, symbol, i, case when thr > 0 and abs(contracts) < thr then 0.0 else round_even(contracts, 0) end as target from sized where i = 0
  union all
  select n.run_id, n.symbol, n.i, case when n.thr > 0 and abs(n.contracts - h.target) < n.thr then h.target else round_even(n.contracts, 0) end
  from held h join sized n on n.run_id = h.run_id and n.symbol = h.symbol and n.i = h.i + 1),
book as (select s.*, h.target from sized s join held h using (run_id, symbol, i))"""

ORDERS = f"""deltas as (
  select *, case when lead(ts) over ({_BY}) is null or abs(target - lag(target, 1, 0) over ({_BY})) <= 1e-8 then 0
    else target - lag(target, 1, 0) over ({_BY}) end as delta from book),
orders as (
  select run_id, symbol, symbol_pos, ts as submitted, i, delta as qty, target,
    row_number() over (partition by run_id order by ts, symbol_pos) as order_id from deltas where delta <> 0)"""

FILLS = f"""arrivals as (
  select *, cast(coalesce(sum(cast(abs(delta) as decimal(28,9))) over ({_BY} rows between unbounded preceding and 1 preceding), 0) as decimal(38,9)) as arrived
  from deltas),
caps_cum as (
  select *, sum(least(cast(greatest(advp * adv, 0) as decimal(28,9)), arrived)) over ({_BY} rows unbounded preceding) as c from arrivals),
curve as (
  select *, case when advp > 0 then c + least(0, min(arrived - c) over ({_BY} rows unbounded preceding)) else arrived end as served from caps_cum),
days as (
  select *, coalesce(lag(served) over ({_BY}), 0) as lo, served as hi from curve),
queue as (
  select run_id, symbol, i, order_id, submitted, qty,
    coalesce(sum(cast(abs(qty) as decimal(28,9))) over ({_BY} rows between unbounded preceding and 1 preceding), 0) as lo,
    sum(cast(abs(qty) as decimal(28,9))) over ({_BY} rows unbounded preceding) as hi from orders),
overlap as (
  select d.run_id, d.symbol, d.symbol_pos, d.ts, d.close, d.adv, d.pv, d.comm, d.k, d.alpha, d.tick, d.mint, q.order_id, q.submitted,
    sign(q.qty) * cast(least(d.hi, q.hi) - greatest(d.lo, q.lo) as double) as qty, q.hi > d.hi as partial
  from days d join queue q on q.run_id = d.run_id and q.symbol = d.symbol and q.lo < d.hi and d.lo < q.hi where d.hi > d.lo),
fills as (
  select *, close as price, qty * close * pv as notional, comm * abs(qty) as commission,
    abs(qty) * (case when adv <= 0 then greatest(mint, k) else greatest(mint, k * pow(least(abs(qty) / adv, 1.0), alpha)) end) * tick as slippage
  from overlap),
costed as (select *, commission + slippage as cost, 'rebalance' as reason from fills)"""

# Execution day by day, independent of the closed form above: each series walks its sessions with its queue of open
# orders as a list.  ``rolls`` (symbol, ts) names the roll dates.
_QUEUE = "struct(open double, sub bigint, leg integer)[]"
WALK = f"""steps as (
  select b.*, r.ts is not null as due, lead(b.ts) over (partition by b.run_id, b.symbol order by b.i) is null as final,
    case when b.advp > 0 then greatest(b.advp * b.adv, 0) else 1e300 end as room
  from book b left join (select distinct symbol, ts from rolls) r on r.symbol = b.symbol and r.ts = b.ts),
walk as (
  select run_id, symbol, i, 0.0::double as position, case when final or abs(target) <= 1e-8 then 0.0 else target end as goal,
    (case when final or abs(target) <= 1e-8 then [] else [{{'open': target, 'sub': i, 'leg': 2}}] end)::{_QUEUE} as sent,
    (case when final or abs(target) <= 1e-8 then [] else [{{'open': target, 'sub': i, 'leg': 2}}] end)::{_QUEUE} as queue,
    []::struct(sub bigint, leg integer, qty double, partial boolean)[] as done
  from steps where i = 0
  union all
  select run_id, symbol, i, position, case when wants then target else goal end, sent, list_concat(rest, sent), done from (
    select *, list_concat(
        (case when due and not final and abs(position) > 1e-8
          then [{{'open': -position, 'sub': i, 'leg': 0}}, {{'open': position, 'sub': i, 'leg': 1}}] else [] end)::{_QUEUE},
        (case when wants then [{{'open': target - goal, 'sub': i, 'leg': 2}}] else [] end)::{_QUEUE}) as sent
    from (
      select run_id, symbol, i, due, final, target, goal, not final and abs(target - goal) > 1e-8 as wants,
        position + coalesce(list_sum(list_transform(cut, lambda c: c.qty)), 0) as position,
        list_transform(list_filter(cut, lambda c: abs(c.qty) > 1e-9), lambda c: {{'sub': c.sub, 'leg': c.leg, 'qty': c.qty, 'partial': abs(c.left) > 1e-9}}) as done,
        list_transform(list_filter(cut, lambda c: abs(c.left) > 1e-9), lambda c: {{'open': c.left, 'sub': c.sub, 'leg': c.leg}}) as rest
      from (
        select n.run_id, n.symbol, n.i, n.due, n.final, n.target, h.goal, h.position,
          list_transform(range(1, len(h.queue) + 1), lambda k: {{'sub': h.queue[k].sub, 'leg': h.queue[k].leg,
            'qty': sign(h.queue[k].open) * greatest(0, least(abs(h.queue[k].open), n.room - coalesce(list_sum(list_transform(h.queue[1:k-1], lambda x: abs(x.open))), 0))),
            'left': h.queue[k].open - sign(h.queue[k].open) * greatest(0, least(abs(h.queue[k].open), n.room - coalesce(list_sum(list_transform(h.queue[1:k-1], lambda x: abs(x.open))), 0)))}}) as cut
        from walk h join steps n on n.run_id = h.run_id and n.symbol = h.symbol and n.i = h.i + 1)))),
walked_orders as (
  select w.run_id, w.symbol, w.o.sub as sub, w.o.leg as leg, b.ts as submitted,
    row_number() over (partition by w.run_id order by b.ts, w.o.leg = 2, b.symbol_pos, w.o.leg) as order_id
  from (select run_id, symbol, i, unnest(sent) as o from walk) w join book b on b.run_id = w.run_id and b.symbol = w.symbol and b.i = w.i),
walked_fills as (
  select b.run_id, b.symbol, b.ts, b.close, b.adv, b.pv, o.order_id, o.submitted, w.d.qty as qty, w.d.partial as partial,
    case when w.d.leg = 2 then 'rebalance' else 'roll' end as reason, b.comm * abs(w.d.qty) + abs(w.d.qty) * b.tick *
      (case when b.adv <= 0 then greatest(b.mint, b.k) else greatest(b.mint, b.k * pow(least(abs(w.d.qty) / b.adv, 1.0), b.alpha)) end) as cost
  from (select run_id, symbol, i, unnest(done) as d from walk) w
  join book b on b.run_id = w.run_id and b.symbol = w.symbol and b.i = w.i
  join walked_orders o on o.run_id = w.run_id and o.symbol = w.symbol and o.sub = w.d.sub and o.leg = w.d.leg)"""

LEDGER = f"""positions as (
  select b.run_id, b.symbol, b.ts, b.i, b.close, b.pv, b.sector, b.nav0, sum(coalesce(f.q, 0)) over (partition by b.run_id, b.symbol order by b.i rows unbounded preceding) as pos
  from book b left join (select run_id, symbol, ts, sum(qty) as q from costed group by 1, 2, 3) f using (run_id, symbol, ts)),
daycost as (select run_id, ts, sum(notional + cost) as spent, sum(cost) as trading_cost from costed group by 1, 2),
assets as (select run_id, ts, any_value(nav0) as nav0, sum(pos * close * pv) as asset_value from positions group by 1, 2),
cashed as (
  select a.run_id, a.ts, a.asset_value, coalesce(d.trading_cost, 0) as trading_cost,
    a.nav0 - sum(coalesce(d.spent, 0)) over (partition by a.run_id order by a.ts rows unbounded preceding) as cash
  from assets a left join daycost d using (run_id, ts)),
ledger as (
  select run_id, ts, cash + asset_value as nav, cash, asset_value,
    coalesce(cash + asset_value - lag(cash + asset_value) over (partition by run_id order by ts), 0) as pnl,
    trading_cost, 0.0 as roll_cost, trading_cost as total_cost from cashed),
contrib as (
  select run_id, symbol, sector, ts, coalesce(lag(pos) over ({_BY}) * (close - lag(close) over ({_BY})) * pv, 0) as pnl from positions)"""

_METRICS = """case when n < 2 or first_nav = 0 then 0 else pow(last_nav / first_nav, 252.0 / (n - 1)) - 1 end as cagr,
    case when nr = 0 then 0 else sd * sqrt(252) end as volatility,
    case when sd > 0 then mean * 252 / (sd * sqrt(252)) else 0 end as sharpe,
    case when down > 0 then mean * 252 / (sqrt(down) * sqrt(252)) else 0 end as sortino, mdd as max_drawdown,
    case when mdd < 0 then (pow(last_nav / first_nav, 252.0 / (n - 1)) - 1) / abs(mdd) else 0 end as calmar,
    sk as skew, ku as kurtosis, coalesce(hit, 0) as hit_rate, mean_nav"""


def metrics(source: str, name: str, by: str = "run_id") -> str:
    """Ten metrics of a table ``(by, ts, nav)``; turnover is joined by the caller."""
    return f"""{name} as (
  select {by}, {_METRICS} from (
    select {by}, count(*) as n, count(ret) as nr, first(nav order by ts) as first_nav, last(nav order by ts) as last_nav,
      avg(ret) as mean, stddev_samp(ret) as sd, avg(ret*ret) filter (ret < 0) as down, min(nav / peak - 1) as mdd,
      skewness(ret) as sk, kurtosis(ret) as ku, avg((ret > 0)::int) as hit, avg(nav) as mean_nav
    from (select {by}, ts, nav, nav / lag(nav) over (partition by {by} order by ts) - 1 as ret,
      max(nav) over (partition by {by} order by ts rows unbounded preceding) as peak from {source}) group by {by}))"""


TURNOVER = "traded as (select run_id, sum(abs(notional)) as traded from costed group by 1)"
SUMMARY = [metrics("ledger", "stats"), TURNOVER,
           "summary as (select s.*, coalesce(t.traded / nullif(s.mean_nav, 0), 0) as turnover from stats s left join traded t using (run_id))"]

STAGES = {"panel": 1, "sized": 2, "book": 3, "orders": 4, "fills": 5, "ledger": 6, "summary": 7}


def backtest_sql(final: str, upto: str, runs: Sequence[str], *more: str) -> str:
    """The chain up to a stage for the given ``runs`` expression(s), then the final select."""
    steps = [PANEL, SIZING, BAND, ORDERS, FILLS, LEDGER, ",\n".join(SUMMARY)][: STAGES[upto]]
    return panel.sql(final, _UNI, *runs, *steps, *more)
