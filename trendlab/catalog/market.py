"""Sources and sinks, calendar, data quality, continuous contracts."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import calendar, continuous, quality
from ..sources import prices as price_files
from ..sources import sinks, universe
from . import panel
from .registry import register

BRAND = "p_brand"


def _price_file(spark, sf_dir, fmt, frame=None):
    """Bars written as price files with a ``date`` column."""
    rows = panel.bars(spark, sf_dir).select("symbol", F.col("ts").alias("date"), "close") if frame is None else frame
    path = sinks.scratch_path(spark, f"prices-{fmt}")
    if fmt == "csv":
        rows.write.csv(path, header=True)
    else:
        rows.write.parquet(path)
    return path


# Sources and sinks ----------------------------------------------------------------------------


@register("a1_csv_scan", "symbol s, ts d, close 6", panel.sql("select symbol, ts, close from bars"))
def a1(spark, sf):
    return price_files.read_prices(spark, _price_file(spark, sf, "csv"), "csv", symbol_column="symbol")


@register("a2_parquet_scan", "symbol s, ts d, close 6", panel.sql("select symbol, ts, close from bars"))
def a2(spark, sf):
    return price_files.read_prices(spark, _price_file(spark, sf, "parquet"), "parquet", symbol_column="symbol")


@register(
    "a3_price_column", "case_no i, resolved s, symbol s, ts d, close 9",
    panel.sql("""select 1 as case_no, 'Settle' as resolved, symbol, ts, close from bars
      union all select 2, 'LAST', symbol, ts, high from bars union all select 3, 'mid', symbol, ts, low from bars"""),
)
def a3(spark, sf):
    bars = panel.stored_bars(spark, sf).withColumn("date", F.col("ts"))
    shapes = [
        bars.select("symbol", "date", F.col("high").alias("LAST"), F.col("close").alias("Settle"), "volume"),
        bars.select("symbol", "date", "volume", F.col("high").alias("LAST")),
        bars.select("symbol", "date", F.col("low").alias("mid")),
    ]
    out = None
    for i, shape in enumerate(shapes, start=1):
        name = price_files.price_column(shape)
        part = shape.select(
            F.lit(i).alias("case_no"), F.lit(name).alias("resolved"), "symbol", F.col("date").alias("ts"),
            F.col(name).cast("double").alias("close"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "a4_date_bounded_scan", "symbol s, ts d, close 6",
    panel.sql("select symbol, ts, close from bars where ts between date '1996-03-01' and date '1998-09-30'"),
)
def a4(spark, sf):
    path = _price_file(spark, sf, "parquet")
    return price_files.read_prices(spark, path, "parquet", "1996-03-01", "1998-09-30", symbol_column="symbol")


@register(
    "a5_combine_sources", "symbol s, ts d, close 6",
    panel.sql("""select symbol, ts, close from bars where symbol < 'M' and ts >= date '1996-01-01'
      union all select symbol, ts, close * 2 from bars where symbol >= 'M'"""),
)
def a5(spark, sf):
    bars = panel.stored_bars(spark, sf).select("symbol", "ts", "close")
    first = bars.filter("symbol < 'M' and ts >= date'1996-01-01'")
    return price_files.combine_sources([first, bars.withColumn("close", F.col("close") * 2)])


@register("a6_source_routing", "symbol s, ts d, close 6", panel.sql("select symbol, ts, close from bars"))
def a6(spark, sf):
    rows = panel.bars(spark, sf).select(F.col("symbol").alias("folder"), F.col("ts").alias("date"), "close")
    path = sinks.scratch_path(spark, "vendor")
    sinks.write_table(rows, path, by="folder")
    instruments = [
        {"symbol": s, "data_source": fmt, "data_symbol": f"{path}/{fmt}/folder={s}"}
        for (s, _, _), fmt in zip(panel.INSTRUMENTS, ("csv", "parquet") * 3, strict=True)
    ]
    return price_files.load_universe_prices(spark, instruments)


@register(
    "a6_paths", "kind s, symbol s, n i, lost i, total 4",
    panel.sql("""select kind, symbol, count(*) as n, 0 as lost, sum(close) as total from bars
      cross join (values ('relative'), ('parent'), ('nested'), ('glob')) k(kind) group by 1, 2"""),
)
def a6_paths(spark, sf):
    """The same files reached by other spellings of their paths, and what each of them loses."""
    bars = panel.stored_bars(spark, sf)
    rows = bars.select(F.col("symbol").alias("folder"), F.year("ts").alias("year"), F.col("ts").alias("date"), "close")
    path = sinks.scratch_path(spark, "vendor")
    rows.write.partitionBy("folder", "year").parquet(path)
    bare = path.removeprefix("file://")
    spelled = {
        "relative": f"{os.path.relpath(bare)}/folder={{}}",
        "parent": f"{bare}/folder=none/../folder={{}}",
        "nested": f"{path}/folder={{}}",
        "glob": f"{path}/folder={{}}/year=*",
    }
    there = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("there"))
    out = []
    for kind, pattern in spelled.items():
        instruments = [{"symbol": s, "data_source": "parquet", "data_symbol": pattern.format(s)} for s, _, _ in panel.INSTRUMENTS]
        read = price_files.load_universe_prices(spark, instruments).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))
        out.append(there.join(read, "symbol", "left").withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out).withColumn("lost", F.col("there") - F.coalesce("n", F.lit(0)))


@register(
    "a7_adjusted_close", "used s, symbol s, ts d, close 9",
    panel.sql("select 'Adj Close' as used, symbol, ts, low as close from bars union all select 'Close', symbol, ts, close from bars"),
)
def a7(spark, sf):
    bars = panel.stored_bars(spark, sf)
    both = bars.select("symbol", "ts", F.col("low").alias("Adj Close"), F.col("close").alias("Close"))
    out = None
    for frame in (both, both.drop("Adj Close")):
        name = price_files.adjusted_close(frame)
        part = frame.select(F.lit(name).alias("used"), "symbol", "ts", F.col(name).alias("close"))
        out = part if out is None else out.unionByName(part)
    return out


def _instrument_drafts(spark, sf):
    return panel.table(spark, sf, "part").select(
        F.col("p_name").alias("symbol"),
        F.when(F.col("p_size") > 3, F.col("p_type")).alias("sector"),
        (F.col("p_retailprice") - 950).alias("point_value"),
        (F.col("p_size") - 5).cast("double").alias("contract_step"),
        F.when(F.col("p_type") == "PROMO", "CSV").when(F.col("p_type") == "SMALL", "parquet").alias("data_source"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x_"), F.col("p_brand"))).alias("data_symbol"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("description"),
    )


_DRAFTS = """select p_name as symbol, case when p_size > 3 then p_type end as sector, p_retailprice - 950 as point_value,
  cast(p_size - 5 as double) as contract_step,
  case when p_type = 'PROMO' then 'CSV' when p_type = 'SMALL' then 'parquet' else 'yahoo' end as data_source,
  case when p_size % 7 = 0 then 'x_' || p_brand end as data_symbol, case when p_size % 2 = 0 then p_brand end as description
  from part"""


@register(
    "a8_universe_checks", "symbol s, problem s",
    f"""with drafts as ({_DRAFTS})
    select symbol, 'sector missing' as problem from drafts where coalesce(sector, '') = ''
    union all select symbol, 'point_value not positive' from drafts where not point_value > 0
    union all select symbol, 'contract_step not positive' from drafts where not contract_step > 0
    union all select symbol, 'duplicate symbol' from drafts group by symbol having count(*) > 1""",
)
def a8(spark, sf):
    return universe.violations(universe.with_defaults(_instrument_drafts(spark, sf)))


@register(
    "a9_vendor_table",
    "symbol s, sector s, point_value 6, currency s, contract_step 6, data_source s, data_symbol s, description s",
    f"""with drafts as ({_DRAFTS})
    select symbol, coalesce(sector, '') as sector, point_value, 'USD' as currency, contract_step, data_source,
      coalesce(data_symbol, case when data_source <> 'yahoo' then symbol when symbol like '%=F' then symbol else symbol || '=F' end)
        as data_symbol, coalesce(description, '') as description from drafts""",
)
def a9(spark, sf):
    return universe.vendor_table(universe.with_defaults(_instrument_drafts(spark, sf)))


@register(
    "a10_table_sink", "format s, symbol s, n i, total 3",
    panel.sql("""select f.format, symbol, count(*) as n, sum(close) as total
      from px cross join (values ('csv'), ('parquet')) f(format) where close is not null group by 1, 2"""),
)
def a10(spark, sf):
    path = sinks.scratch_path(spark, "sink")
    rows = panel.aligned(spark, sf).filter("close is not null")
    sinks.write_table(rows.withColumn("run_id", F.lit("base")), path)
    schema = "symbol string, ts date, close double"
    out = None
    for fmt in ("csv", "parquet"):
        reader = spark.read.schema(schema)
        back = reader.csv(f"{path}/csv", header=True) if fmt == "csv" else reader.parquet(f"{path}/parquet")
        part = back.groupBy(F.lit(fmt).alias("format"), "symbol").agg(
            F.count(F.lit(1)).alias("n"), F.sum("close").alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "a13_wide_panel", "ts d, economy 6, large 6, medium 6, promo 6, small 6, standard 6",
    panel.sql("""select ts, max(close) filter (symbol = 'ECONOMY') as economy, max(close) filter (symbol = 'LARGE') as large,
      max(close) filter (symbol = 'MEDIUM') as medium, max(close) filter (symbol = 'PROMO') as promo,
      max(close) filter (symbol = 'SMALL') as small, max(close) filter (symbol = 'STANDARD') as standard from px group by ts"""),
)
def a13(spark, sf):
    wide = calendar.to_wide(panel.aligned(spark, sf), [s for s, _, _ in panel.INSTRUMENTS])
    return wide.select("ts", *[F.col(s).alias(s.lower()) for s, _, _ in panel.INSTRUMENTS])


@register("a13_long_panel", "symbol s, ts d, close 6", panel.sql("select symbol, ts, close from px"))
def a13_long(spark, sf):
    wide = calendar.to_wide(panel.aligned(spark, sf), [s for s, _, _ in panel.INSTRUMENTS])
    return calendar.to_long(wide)


# Calendar -------------------------------------------------------------------------------------


@register("b1_sessions", "ts d", panel.sql("select ts from sess"))
def b1(spark, sf):
    return calendar.sessions(spark, *panel.bounds(panel.bars(spark, sf)))


def _quiet_days(bars):
    volume = bars.groupBy("ts").agg(F.sum("volume").alias("v"), F.count(F.lit(1)).alias("n"))
    return volume.filter("n < 6").select("ts")


@register(
    "b2_holidays", "ts d",
    panel.sql("select ts from sess where ts not in (select ts from bars group by ts having count(*) < 6)"),
)
def b2(spark, sf):
    bars = panel.stored_bars(spark, sf)
    return calendar.sessions(spark, *panel.bounds(bars), holidays=_quiet_days(bars))


@register("b3_align", "symbol s, ts d, close 6", panel.sql("select symbol, ts, close from px", by=BRAND))
def b3(spark, sf):
    return panel.aligned(spark, sf, BRAND)


@register(
    "b4_duplicate_dates", "symbol s, ts d, n i",
    panel.sql("select symbol, ts, count(*) as n from trades group by 1, 2 having count(*) > 1", by=BRAND),
)
def b4(spark, sf):
    return calendar.duplicate_dates(panel.trades(spark, sf, BRAND))


@register(
    "b5_complete_panel", "symbol s, ts d, close 6",
    panel.sql(
        """select symbol, ts, close from (select *, count(close) over (partition by ts) as c from px)
        where c = (select count(distinct symbol) from bars)""",
        by=BRAND,
    ),
)
def b5(spark, sf):
    px = panel.stored_panel(spark, sf, BRAND).drop("adv")
    return calendar.complete_panel(px)


@register(
    "b6_align_volume", "symbol s, ts d, adv 6",
    panel.sql(
        """select symbol, ts, coalesce(
          last_value(v ignore nulls) over (partition by symbol order by ts rows unbounded preceding),
          first_value(v ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following),
          10000.0) as adv from (
            select p.symbol, p.ts, case when p.symbol <> 'Brand#7' then cast(b.volume as double) end as v
            from px p left join bars b on b.symbol = p.symbol and b.ts = p.ts)""",
        by=BRAND,
    ),
)
def b6(spark, sf):
    px = panel.stored_panel(spark, sf, BRAND)
    adv = px.filter("symbol <> 'Brand#7'").select("symbol", "ts", "adv")
    return calendar.align_volume(px, adv, 10_000.0)


# Data quality ---------------------------------------------------------------------------------


@register(
    "c1_price_sanity", "symbol s, ts d, problem s, close 6",
    panel.sql("""select symbol, ts, 'duplicate_date' as problem, cast(null as double) as close from trades group by 1, 2 having count(*) > 1
      union all select symbol, ts, 'min_price', disc/100.0 from trades where disc <= 0"""),
)
def c1(spark, sf):
    quotes = panel.trades(spark, sf).select("symbol", "ts", (F.col("disc") / 100.0).alias("close"))
    return quality.price_violations(quotes, 0.0)


_SPANS = """runs as (
  select symbol, min(ts) as start, max(ts) as "end", count(*) as length from (
    select symbol, ts, i - row_number() over (partition by symbol order by ts) as grp from (
      select symbol, ts, close, row_number() over (partition by symbol order by ts) as i from gaps) where close is null)
  group by symbol, grp)"""


@register(
    "c2_gap_limit", "symbol s, longest i, n_gaps i",
    panel.sql("select symbol, max(length) as longest, count(*) as n_gaps from runs where length > 3 group by symbol", _SPANS, by=BRAND),
)
def c2(spark, sf):
    return quality.gap_violations(panel.gaps(spark, sf, BRAND), 3)


@register(
    "c3_suspensions", "symbol s, start d, end d, length i",
    panel.sql("select * from runs where length > 3", _SPANS, by=BRAND),
)
def c3(spark, sf):
    return quality.suspension_spans(panel.gaps(spark, sf, BRAND), 3)


@register(
    "c4_limit_moves", "symbol s, ts d, flagged b",
    panel.sql(
        "select symbol, ts, flagged from (select *, bool_or(flagged) over (partition by ts) as hit from moves) where hit",
        """moves as (select symbol, ts, coalesce(abs(close / lag(close) over (partition by symbol order by ts) - 1) > 0.05, false) as flagged
        from px)""",
        by=BRAND,
    ),
)
def c4(spark, sf):
    return quality.limit_moves(panel.gaps(spark, sf, BRAND), 0.05)


# Continuous contracts -------------------------------------------------------------------------


def _schedule(px, by):
    """Roll to the next contract every 120 sessions, starting over after the last one."""
    days = px.select("ts").distinct()
    numbered = days.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("pos"))
    starts = numbered.filter("pos % 120 = 0").select(F.col("ts").alias("start_ts"), (F.col("pos") / 120).cast("int").alias("k"))
    if by == BRAND:
        root = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")
        starts = starts.select("*", root)
        number = 5 * (F.col("k") % 5) + F.col("r") + 1
        return starts.select(
            F.concat(F.lit("R"), "r").alias("root"), "start_ts", F.concat(F.lit("Brand#"), number).alias("contract")
        )
    names = F.array(*[F.lit(s) for s, _, _ in panel.INSTRUMENTS])
    return starts.select(F.lit("R").alias("root"), "start_ts", F.element_at(names, F.col("k") % 6 + 1).alias("contract"))


def _contracts(px):
    return px.select(F.col("symbol").alias("contract"), "ts", F.col("close").alias("price"))


_STARTS = "starts as (select ts, cast(p / 120 as bigint) as k from (select ts, row_number() over (order by ts) - 1 as p from sess) where p % 120 = 0)"
_PLAN = {
    "p_type": """plan as (select 'R' as root, ts, k,
      (['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'])[(k % 6) + 1] as contract from starts)""",
    BRAND: """plan as (select 'R' || r as root, ts, k, 'Brand#' || (5*(k % 5) + r + 1) as contract
      from starts cross join (select unnest(range(5)) as r))""",
}
_SEGMENTS = """seg as (select root, k, ts as start_ts, contract, lead(ts) over (partition by root order by ts) as end_ts,
  lead(contract) over (partition by root order by ts) as next_contract from plan)"""
_FRONT = """front as (select s.root, s.k, s.contract, p.ts, p.close as price from seg s join px p
  on p.symbol = s.contract and p.ts >= s.start_ts and (s.end_ts is null or p.ts < s.end_ts))"""
_LINKS = """links as (
  select s.root, s.k, first(f.price order by f.ts) as p0, last(f.price order by f.ts) as p1, max(n.close) as pn
  from seg s join front f on f.root = s.root and f.k = s.k
  left join px n on n.symbol = s.next_contract and n.ts = (select max(t.ts) from sess t where t.ts < s.end_ts)
  group by s.root, s.k)"""
_ADJ = """adj as (
  select root, k,
    coalesce(sum(p1 - pn) over w, 0) as back, coalesce(product(p1 / pn) over w, 1) as ratio,
    coalesce(product(p1) over w / product(nextp0) over w, 1) as stitch
  from (select *, lead(p0) over (partition by root order by k) as nextp0 from links)
  window w as (partition by root order by k rows between unbounded preceding and 1 preceding))"""


def _roll_sql(final: str, by: str = "p_type", *more: str) -> str:
    return panel.sql(final, _STARTS, _PLAN[by], _SEGMENTS, *more, by=by)


@register(
    "d1_intervals", "root s, k i, start_ts d, end_ts d, contract s",
    _roll_sql("select root, k, start_ts, end_ts, contract from seg", BRAND),
)
def d1(spark, sf):
    return continuous.intervals(_schedule(panel.aligned(spark, sf, BRAND), BRAND))


@register(
    "d2_front_contract", "root s, k i, contract s, ts d, price 6",
    _roll_sql("select root, k, contract, ts, price from front", BRAND, _FRONT),
)
def d2(spark, sf):
    px = panel.stored_panel(spark, sf, BRAND)
    return continuous.front_prices(_contracts(px), _schedule(px, BRAND))


_SERIES = {
    "back_adjusted": "select root, ts, price + back as price from front join adj using (root, k) where price is not null",
    "ratio_adjusted": "select root, ts, price * ratio as price from front join adj using (root, k) where price is not null",
    "stitched": "select root, ts, price * stitch as price from front join adj using (root, k) where price is not null",
}


def _series(method, by):
    def plan(spark, sf):
        px = panel.stored_panel(spark, sf, by)
        return continuous.continuous_series(_contracts(px), _schedule(px, by), method)

    return plan


for _key, _method in (("d3_back_adjusted", "back_adjusted"), ("d4_ratio_adjusted", "ratio_adjusted"), ("d5_stitched", "stitched")):
    register(_key, "root s, ts d, price 6", _roll_sql(_SERIES[_method], "p_type", _FRONT, _LINKS, _ADJ))(_series(_method, "p_type"))


@register(
    "d6_many_roots", "method s, root s, ts d, price 6",
    _roll_sql(
        " union all ".join(f"select '{m}' as method, * from ({q})" for m, q in _SERIES.items()), BRAND, _FRONT, _LINKS, _ADJ
    ),
)
def d6(spark, sf):
    px = panel.stored_panel(spark, sf, BRAND)
    return continuous.continuous_matrix(_contracts(px), _schedule(px, BRAND))


# Quotes as they are, sessions without one left empty: many rolls fall on a session on which a contract is not quoted.
_LINKS_GAPS = """links as (
  select s.root, s.k, s.contract, s.next_contract, s.end_ts, max(a.ts) as link_ts, arg_max(a.close, a.ts) as p1, arg_max(b.close, a.ts) as pn
  from seg s left join (gaps a join gaps b on a.ts = b.ts and a.close is not null and b.close is not null)
    on a.symbol = s.contract and b.symbol = s.next_contract and a.ts < s.end_ts
  group by all),
last_session as (select s.root, s.k, max(t.ts) as last_ts from seg s join sess t on t.ts >= s.start_ts and (s.end_ts is null or t.ts < s.end_ts) group by all)"""
_FRONT_GAPS = """front as (select s.root, s.k, s.contract, p.ts, p.close as price from seg s join gaps p
  on p.symbol = s.contract and p.ts >= s.start_ts and (s.end_ts is null or p.ts < s.end_ts) where p.close is not null)"""
_ADJ_GAPS = """quoted as (select root, k, first(price order by ts) as p0, last(price order by ts) as plast from front group by all),
steps as (
  select l.root, l.k, p1, pn, p0, last_value(plast ignore nulls) over (partition by l.root order by l.k rows between unbounded preceding and 1 preceding) as before
  from links l left join quoted q on l.root = q.root and l.k = q.k),
adj as (
  select root, k, coalesce(sum(p1 - pn) over w, 0) as back, coalesce(product(p1 / pn) over w, 1) as ratio,
    product(case when p0 is null or before is null then 1 else before / p0 end) over (partition by root order by k) as stitch
  from steps
  window w as (partition by root order by k rows between unbounded preceding and 1 preceding))"""


@register(
    "d_roll_links", "root s, k i, contract s, next_contract s, end_ts d, link_ts d, gap_days i, link_price 6, next_price 6",
    _roll_sql(
        """select l.*, p1 as link_price, pn as next_price, datediff('day', link_ts, last_ts) as gap_days
        from links l join last_session using (root, k)""",
        BRAND, _LINKS_GAPS,
    ),
)
def d_roll_links(spark, sf):
    """Where each roll is linked when contracts are not quoted every session."""
    px = sinks.stored(panel.gaps(spark, sf, BRAND), "gaps")
    return continuous.roll_links(_contracts(px), _schedule(px, BRAND))


@register(
    "d6_unquoted_rolls", "method s, root s, ts d, price 6",
    _roll_sql(
        " union all ".join(f"select '{m}' as method, * from ({q})" for m, q in _SERIES.items()),
        BRAND, _LINKS_GAPS, _FRONT_GAPS, _ADJ_GAPS,
    ),
)
def d6_unquoted_rolls(spark, sf):
    px = sinks.stored(panel.gaps(spark, sf, BRAND), "gaps")
    return continuous.continuous_matrix(_contracts(px), _schedule(px, BRAND))


@register(
    "d_violations", "root s, contract s, problem s",
    _roll_sql(
        """select distinct root, next_contract as contract, 'zero price before its roll' as problem from seg where root = 'R0' and end_ts is not null
            and next_contract = (select min(contract) from seg where root = 'R0')
        union all select distinct root, contract, 'no prices' from seg where root = 'R1' and contract = (select max(contract) from seg where root = 'R1')
        union all select distinct root, contract, 'no common quote before its roll' from seg where root = 'R2' and k = 2""",
        BRAND,
    ),
)
def d_violations(spark, sf):
    """A contract of one root always at zero, one of another root without any price, and one of a third without a quote before its roll."""
    px = panel.stored_panel(spark, sf, BRAND)
    plan = _schedule(px, BRAND)
    names = plan.groupBy("root").agg(F.min("contract").alias("lo"), F.max("contract").alias("hi"))
    gone = names.filter("root = 'R1'").select(F.col("hi").alias("contract"))
    zero = names.filter("root = 'R0'").select(F.col("lo").alias("contract"), F.lit(True).alias("zero"))
    late = continuous.intervals(plan).filter("root = 'R2' and k = 2").select("contract", F.col("start_ts").alias("from"))
    prices = _contracts(px).join(gone, "contract", "left_anti").join(zero, "contract", "left").join(late, "contract", "left")
    prices = prices.filter("from is null or ts >= from")
    prices = prices.withColumn("price", F.when(F.col("zero"), 0.0).otherwise(F.col("price"))).drop("zero", "from")
    return continuous.link_violations(prices, plan, ["ratio_adjusted"]).distinct()
