"""Calendar, quality, continuous series and sources on small hand-made tables."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trendlab.operators import calendar, continuous, quality
from trendlab.sources import manifest, sinks, universe
from trendlab.sources import prices as files


def _dict(df, *keys, value="close"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_align_fills_missing_session(long_prices):
    px = long_prices([dt.date(2024, 1, 1), dt.date(2024, 1, 3)], {"ES": [100, 101]})
    got = _dict(calendar.align(px, "2024-01-01", "2024-01-03"), "ts")
    assert got == {(dt.date(2024, 1, 1),): 100, (dt.date(2024, 1, 2),): 100, (dt.date(2024, 1, 3),): 101}


@pytest.mark.parametrize("as_table", [False, True])
def test_align_respects_holidays(spark, long_prices, as_table):
    px = long_prices([dt.date(2024, 1, 1), dt.date(2024, 1, 3)], {"ES": [100, 101]})
    holidays = spark.createDataFrame([("2024-01-02",)], "day string") if as_table else ["2024-01-02"]
    got = _dict(calendar.align(px, "2024-01-01", "2024-01-03", holidays), "ts")
    assert sorted(k[0].day for k in got) == [1, 3]


def test_align_matches_reindex_and_fill_on_random_tables(spark):
    rng = random.Random(3)
    first = dt.date(2024, 1, 1)
    rows = []
    for symbol in "ABCDE":
        for offset in sorted(rng.sample(range(-10, 50), 18)):
            rows.append((symbol, first + dt.timedelta(days=offset), None if rng.random() < 0.2 else float(rng.randint(1, 99))))
    rows.append(("W", dt.date(2024, 1, 6), 5.0))  # a symbol that never trades on a session
    table = spark.createDataFrame(rows, "symbol string, ts date, close double")
    start, end, holidays = dt.date(2024, 1, 3), dt.date(2024, 2, 9), {dt.date(2024, 1, 15)}
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    days = [d for d in days if d.weekday() < 5 and d not in holidays]
    known = {(s, d): v for s, d, v in rows}
    want, raw = {}, {}
    for symbol in "ABCDEW":
        last = None
        for day in days:
            raw[symbol, day] = known.get((symbol, day))
            last = raw[symbol, day] if raw[symbol, day] is not None else last
            want[symbol, day] = last
    assert _dict(calendar.align(table, start, end, holidays), "symbol", "ts") == want
    assert _dict(calendar.align(table, start, end, holidays, fill=False), "symbol", "ts") == raw


def test_duplicate_dates_are_rejected(long_prices):
    day = dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        calendar.validate(long_prices([day, day], {"ES": [1, 2]}))


def test_complete_panel_starts_when_all_have_a_price(long_prices, weekdays):
    px = long_prices(weekdays("2024-01-01", 4), {"A": [None, 1, None, 3], "B": [5, 6, 7, 8], "C": [None] * 4})
    got = _dict(calendar.complete_panel(px), "symbol", "ts")
    days = weekdays("2024-01-01", 4)
    assert got == {("A", days[1]): 1, ("A", days[2]): 1, ("A", days[3]): 3, ("B", days[1]): 6, ("B", days[2]): 7, ("B", days[3]): 8}


def test_volume_sources(spark, long_prices, weekdays):
    days = weekdays("2024-01-01", 3)
    px = long_prices(days, {"A": [1, 1, 1], "B": [1, 1, 1]})
    daily = spark.createDataFrame([("A", days[1], 7.0)], "symbol string, ts date, adv double")
    assert {r.adv for r in calendar.align_volume(px, daily, 50.0).filter("symbol='A'").collect()} == {7.0}
    assert {r.adv for r in calendar.align_volume(px, daily, 50.0).filter("symbol='B'").collect()} == {50.0}
    assert {(r.symbol, r.adv) for r in calendar.align_volume(px, {"A": 3}, 9.0).collect()} == {("A", 3.0), ("B", 9.0)}
    assert {r.adv for r in calendar.align_volume(px, 4, 9.0).collect()} == {4.0}


def test_non_positive_price_is_rejected(long_prices, weekdays):
    px = long_prices(weekdays("2024-01-01", 5), {"ES": [100, 101, -2, 103, 104]})
    assert quality.price_violations(px).count() == 1
    with pytest.raises(ValueError):
        quality.assert_clean(px)
    quality.assert_clean(px, min_price=None)


def test_suspension_span(long_prices, weekdays):
    days = weekdays("2024-01-01", 7)
    px = long_prices(days, {"ES": [100, None, None, None, None, 105, 106], "CL": [50, 51, None, 53, 54, 55, 56]})
    (span,) = quality.suspension_spans(px, 2).collect()
    assert (span.symbol, span.start, span.end, span.length) == ("ES", days[1], days[4], 4)
    assert quality.suspension_spans(px, 4).count() == 0  # strictly longer
    with pytest.raises(ValueError):
        quality.assert_clean(px, max_consecutive_missing=2)
    quality.assert_clean(px, max_consecutive_missing=-1)


def test_limit_move(long_prices, weekdays):
    days = weekdays("2024-02-01", 5)
    px = long_prices(days, {"ES": [100, 105, 160, 161, 162], "CL": [50, 50.5, 50.6, 50.7, 50.8]})
    got = {(r.symbol, r.ts): r.flagged for r in quality.limit_moves(px, 0.4).collect()}
    assert got == {("ES", days[2]): True, ("CL", days[2]): False}


def _contracts(long_prices, days):
    return long_prices(
        days, {"ES_H": range(100, 106), "ES_M": range(110, 116), "ES_U": range(120, 126)}, value="price", key="contract"
    )


def test_back_adjusted_numbers(spark, long_prices, weekdays):
    days = weekdays("2024-01-01", 6)
    schedule = spark.createDataFrame(
        [("ES", days[0], "ES_H"), ("ES", days[3], "ES_M"), ("ES", days[5], "ES_U")], "root string, start_ts date, contract string"
    )
    got = _dict(continuous.continuous_series(_contracts(long_prices, days), schedule), "ts", value="price")
    assert (got[(days[2],)], got[(days[3],)], got[(days[5],)]) == (102, 103, 105)


def _loop_series(prices, days, plan, method):
    """The rule day by day: carry one adjustment from roll to roll."""
    out, offset, factor, last_value = {}, 0.0, 1.0, None
    for k, (start, contract) in enumerate(plan):
        end = plan[k + 1][0] if k + 1 < len(plan) else None
        inside = [d for d in days if d >= start and (end is None or d < end)]
        if not inside:
            continue
        values = [prices[contract, d] for d in inside]
        if method == "back_adjusted":
            values = [v + offset for v in values]
        elif method == "ratio_adjusted":
            values = [v * factor for v in values]
        elif last_value is not None:
            values = [v / prices[contract, inside[0]] * last_value for v in values]
        out.update(zip(inside, values, strict=True))
        last_value = values[-1]
        if end is not None:
            new = prices[plan[k + 1][1], inside[-1]]
            offset, factor = values[-1] - new, values[-1] / new
    return out


@pytest.mark.parametrize("method", continuous.METHODS)
def test_continuous_matches_loop_with_an_empty_segment(spark, weekdays, method):
    days = weekdays("2024-01-01", 30)
    rng = random.Random(5)
    prices = {(c, d): rng.uniform(50, 150) for c in "HMUZ" for d in days}
    saturday = dt.date(2024, 1, 20)
    plan = [(days[2], "H"), (days[9], "M"), (saturday, "U"), (dt.date(2024, 1, 21), "Z"), (days[22], "H")]
    table = spark.createDataFrame([(c, d, p) for (c, d), p in prices.items()], "contract string, ts date, price double")
    schedule = spark.createDataFrame([("R", d, c) for d, c in plan], "root string, start_ts date, contract string")
    got = _dict(continuous.continuous_series(table, schedule, method), "ts", value="price")
    want = _loop_series(prices, days, plan, method)
    assert {k[0] for k in got} == set(want)
    for (day,), value in got.items():
        assert value == pytest.approx(want[day], rel=1e-12)


def _loop_links(quotes, days, plan):
    """The last session before each roll, in or before the segment, on which both contracts are quoted."""
    found = {}
    for k, (start, contract) in enumerate(plan[:-1]):
        end, following = plan[k + 1]
        inside = [d for d in days if start <= d < end]
        common = [d for d in days if d < end and quotes.get((contract, d)) is not None and quotes.get((following, d)) is not None]
        if inside:
            found[k] = (max(common, default=None), max(inside))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_rolls_without_quotes_are_linked_on_the_last_common_session(spark, weekdays, seed):
    rng = random.Random(seed)
    days = weekdays("2024-01-01", 40)
    quotes = {(c, d): rng.choice([None, rng.uniform(50, 150), rng.uniform(50, 150)]) for c in "HMUZ" for d in days if rng.random() > 0.3}
    quotes |= {("H", days[0]): 100.0, ("H", days[39]): None, **{(c, days[1]): 90.0 for c in "HMUZ"}}
    plan = [(days[2], "H"), (days[9], "M"), (days[11], "U"), (days[12], "Z"), (days[25], "H"), (days[33], "M")]
    table = spark.createDataFrame([(c, d, p) for (c, d), p in quotes.items()], "contract string, ts date, price double")
    schedule = spark.createDataFrame([("R", d, c) for d, c in plan], "root string, start_ts date, contract string")
    seen = sorted({d for _, d in quotes})
    want = _loop_links(quotes, seen, plan)
    got = {r["k"]: r for r in continuous.roll_links(table, schedule).collect() if r["next_contract"]}
    assert {k: r["link_ts"] for k, r in got.items()} == {k: link for k, (link, _) in want.items()}
    assert all(r["gap_days"] == (want[k][1] - r["link_ts"]).days for k, r in got.items() if r["link_ts"])
    expected = {m: {} for m in continuous.METHODS}
    offset, factor, last = 0.0, 1.0, None
    for k, (start, contract) in enumerate(plan):
        end = plan[k + 1][0] if k + 1 < len(plan) else None
        inside = [d for d in seen if d >= start and (end is None or d < end) and quotes.get((contract, d)) is not None]
        scale = 1.0 if last is None or not inside else last / quotes[contract, inside[0]]
        for d in inside:
            price = quotes[contract, d]
            expected["back_adjusted"][d], expected["ratio_adjusted"][d], expected["stitched"][d] = price + offset, price * factor, price * scale
            last = price * scale
        if k in want:
            one, two = quotes[contract, want[k][0]], quotes[plan[k + 1][1], want[k][0]]
            offset, factor = offset + one - two, factor * one / two
    rows = continuous.continuous_matrix(table, schedule).collect()
    assert {(r["method"], r["ts"]) for r in rows} == {(m, d) for m, series in expected.items() for d in series}
    for r in rows:
        assert r["price"] == pytest.approx(expected[r["method"]][r["ts"]], rel=1e-12)


def test_a_roll_without_any_common_session_is_named(spark, weekdays):
    days = weekdays("2024-01-01", 9)
    rows = [("H", d, 100.0) for d in days[:6]] + [("M", d, 110.0) for d in days[3:]] + [("U", d, 120.0) for d in days[6:]]
    table = spark.createDataFrame(rows, "contract string, ts date, price double")
    schedule = spark.createDataFrame([("R", days[0], "H"), ("R", days[3], "M"), ("R", days[6], "U")], "root string, start_ts date, contract string")
    problems = {(r["contract"], r["problem"]) for r in continuous.link_violations(table, schedule).collect()}
    assert problems == {("M", "no common quote before its roll"), ("U", "no common quote before its roll")}
    with pytest.raises(ValueError, match="no common quote"):
        continuous.continuous_series(table, schedule)
    assert continuous.continuous_series(table, schedule, "stitched").count() == 9  # needs no common session
    assert continuous.continuous_series(table, schedule, check=False).count() == 3
    late = spark.createDataFrame([r for r in rows if r[:2] not in {("H", days[2])}] + [("M", days[0], 109.0), ("U", days[5], 121.0)], table.schema)
    assert continuous.continuous_series(late, schedule).count() == 8  # linked one day before the last session
    with pytest.raises(ValueError, match="within 0 days"):
        continuous.continuous_series(late, schedule, max_gap_days=0)


def test_continuous_errors(spark, long_prices, weekdays):
    days = weekdays("2024-01-01", 6)
    schedule = spark.createDataFrame([("ES", days[0], "ES_H")], "root string, start_ts date, contract string")
    with pytest.raises(ValueError):
        continuous.continuous_series(_contracts(long_prices, days), schedule, "unknown")
    with pytest.raises(ValueError):
        continuous.continuous_series(_contracts(long_prices, days), schedule.limit(0), check=True)
    assert continuous.continuous_series(_contracts(long_prices, days), schedule, "stitch_returns").count() == 6


def test_csv_source_and_routing(spark, tmp_path):
    one = tmp_path / "ES.csv"
    one.write_text("date,close\n2024-01-01,100\n2024-01-02,101\n2024-01-03,102\n2024-01-04,103\n")
    two = tmp_path / "CL.csv"
    two.write_text("date,open,Settle\n2024-01-03,1,50\n")
    spark.createDataFrame([(dt.date(2024, 1, 3), 7.0)], "date date, last double").write.parquet(str(tmp_path / "GC"))
    instruments = [
        {"symbol": "ES", "data_source": "csv", "data_symbol": str(one)},
        {"symbol": "CL", "data_source": "CSV", "data_symbol": str(two)},
        {"symbol": "GC", "data_source": "parquet", "data_symbol": str(tmp_path / "GC")},
        {"symbol": "XX", "data_source": "synthetic"},
    ]
    got = _dict(files.load_universe_prices(spark, instruments, "2024-01-02", "2024-01-03"), "symbol", "ts")
    day = dt.date(2024, 1, 3)
    assert got == {("ES", dt.date(2024, 1, 2)): 101, ("ES", day): 102, ("CL", day): 50, ("GC", day): 7}
    with pytest.raises(ValueError):
        files.load_universe_prices(spark, [{"symbol": "A", "data_source": "csv"}])
    with pytest.raises(FileNotFoundError):
        files.load_universe_prices(spark, [{"symbol": "A", "data_source": "csv", "data_symbol": str(tmp_path / "none.csv")}])


def test_paths_in_any_spelling_find_their_rows(spark, tmp_path, monkeypatch):
    day = dt.date(2024, 1, 3)
    rows = [(f, y, dt.date(y, 1, 3), 10.0 * k + y) for k, f in enumerate(("ES", "a b+c")) for y in (2023, 2024)]
    table = spark.createDataFrame(rows, "folder string, year int, date date, close double")
    table.write.partitionBy("folder", "year").parquet(str(tmp_path / "vendor"))
    folders = {p.name for p in (tmp_path / "vendor").iterdir() if p.is_dir()}
    here = os.path.relpath(tmp_path)
    for spelled in (f"{tmp_path}/vendor/{{}}", f"{here}/vendor/{{}}", f"{tmp_path}/none/../vendor/{{}}/", f"file:{tmp_path}/vendor/{{}}/year=*"):
        items = [{"symbol": f, "data_source": "parquet", "data_symbol": spelled.format(f)} for f in folders]
        got = _dict(files.load_universe_prices(spark, items), "symbol", "ts")
        assert len(got) == 4 and {k[0] for k in got} == folders, spelled
    single = next((tmp_path / "vendor" / "folder=ES" / "year=2024").glob("*.parquet"))
    one = files.load_universe_prices(spark, [{"symbol": "S", "data_source": "parquet", "data_symbol": str(single)}])
    assert _dict(one, "symbol", "ts") == {("S", day): 2024.0}
    (tmp_path / "empty").mkdir()
    with pytest.raises((FileNotFoundError, AnalysisException)):
        files.load_universe_prices(spark, [{"symbol": "E", "data_source": "parquet", "data_symbol": str(tmp_path / "empty")}])


def test_many_files_in_one_manifest(spark, tmp_path):
    """80 instruments in files of several shapes; footers keep years out of the scan that the dates do not touch."""
    days = [dt.date(2020 + y, 6, d) for y in range(4) for d in (1, 2)]
    rows = [(f"S{k:03d}", d.year, d, 1.0 * k + d.year + d.day) for k in range(40) for d in days]
    table = spark.createDataFrame(rows, "s string, y int, date date, settle double").repartition(4, "s")
    table.write.partitionBy("s", "y").parquet(str(tmp_path / "p"))
    (tmp_path / "c").mkdir()
    for k in range(40):
        name = "close" if k % 2 else "Last"
        (tmp_path / "c" / f"C[{k}],{{x}} +%20.csv").write_text(f"date,{name}\n2021-06-01,{k}\n2022-06-01,{k + 1}\n")
    (tmp_path / "c" / "C[9],{x} +%20.csv").write_text("\n\n")
    parquet = [{"symbol": f"S{k:03d}", "data_source": "parquet", "data_symbol": f"{tmp_path}/p/s=S{k:03d}"} for k in range(40)]
    csv = [{"symbol": f"C{k}", "data_source": "csv", "data_symbol": f"{tmp_path}/c/C\\[{k}\\]*"} for k in range(40)]
    got = files.load_universe_prices(spark, parquet + csv, "2021-01-01", "2022-12-31")
    assert not [f for f in got.inputFiles() if "y=2020" in f or "y=2023" in f]
    want = {(s, d): v for s, y, d, v in rows if y in (2021, 2022)}
    want |= {(f"C{k}", dt.date(2021 + i, 6, 1)): float(k + i) for k in range(40) if k != 9 for i in (0, 1)}
    found = got.collect()
    assert len(found) == len(want) and {(r.symbol, r.ts): r.close for r in found} == want
    listed = manifest.price_manifest(spark, parquet[:2], "parquet").filter("symbol = 'S001'").orderBy("first").collect()
    assert [(r.first, r.last) for r in listed] == [(dt.date(y, 6, 1), dt.date(y, 6, 2)) for y in range(2020, 2024)]


@pytest.mark.parametrize(
    "path, above, hits, misses",
    [
        ("/d/x", "file:/d/x", (), ()),
        ("file:///d//y/../x/", "file:/d/x", (), ()),
        ("x", "file:/home/x", (), ()),
        ("/", "file:", (), ()),
        ("hdfs://h:1/d/x", "hdfs://h:1/d/x", (), ()),
        ("/d/*/q.csv", "file:/d", ("file:/d/a/q.csv",), ("file:/d/a/b/q.csv", "file:/e/a/q.csv", "file:/d/a/qxcsv")),
        ("/d/{a,b{1,2}}x?", "file:/d", ("file:/d/axz", "file:/d/b2xz/part"), ("file:/d/bxz", "file:/d/ax")),
        ("/d/[a-c][^x]\\*", "file:/d", ("file:/d/by*",), ("file:/d/bx*", "file:/d/byz")),
    ],
)
def test_places_of_paths(path, above, hits, misses):
    found, pattern = manifest._place(path, "file:/home")
    assert found == above and (pattern is None) == (not hits)
    assert all(re.search(pattern, h) for h in hits) and not any(re.search(pattern, m) for m in misses)


def test_files_whose_footers_say_nothing_are_read(spark, tmp_path):
    text = spark.createDataFrame([("2024-01-03", 7.0)], "date string, close double")
    text.write.parquet(str(tmp_path / "T"))
    late = spark.createDataFrame([(dt.datetime(2024, 1, 3, 23, 30), 8.0)], "date timestamp, close double")
    late.write.option("compression", "none").parquet(str(tmp_path / "U"))
    items = [{"symbol": s, "data_source": "parquet", "data_symbol": str(tmp_path / s)} for s in "TU"]
    got = _dict(files.load_universe_prices(spark, items, "2024-01-03", "2024-01-03"), "symbol", "ts")
    assert got == {("T", dt.date(2024, 1, 3)): 7, ("U", dt.date(2024, 1, 3)): 8}


def test_missing_words_in_csv(spark, tmp_path):
    path = tmp_path / "ES.csv"
    path.write_text("date,close\n2024-01-01,N/A\n2024-01-02,101\n2024-01-03, null\n2024-01-04,\n2024-01-05,NaN\n")
    item = {"symbol": "ES", "data_source": "csv", "data_symbol": str(path)}
    assert [v for v in _dict(files.load_universe_prices(spark, [item]), "symbol", "ts").values() if v is not None] == [101]
    path.write_text("date,close\n2024-01-01,twelve\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.load_universe_prices(spark, [item]).collect()


def test_load_panel_checks_aligns_and_checks(spark, tmp_path):
    def item(symbol, text):
        (tmp_path / f"{symbol}.csv").write_text("date,close\n" + text)
        return {"symbol": symbol, "data_source": "csv", "data_symbol": str(tmp_path / f"{symbol}.csv")}

    good = item("ES", "2024-01-01,100\n2024-01-03,102\n2024-01-05,103\n")
    panel = _dict(files.load_panel(spark, [good], "2024-01-01", "2024-01-05"), "symbol", "ts")
    assert [panel["ES", dt.date(2024, 1, d)] for d in range(1, 6)] == [100, 100, 102, 102, 103]
    for text, problem in (
        ("2024-01-01,100\n2024-01-01,101\n", "date"),
        ("2024-01-01,100\n2024-01-02,-1\n", "violation"),
        ("2024-01-01,100\n2024-01-12,101\n", "gap"),
        ("2023-01-02,100\n", "without a price"),
    ):
        with pytest.raises(ValueError, match=problem):
            files.load_panel(spark, [good, item("CL", text)], "2024-01-01", "2024-01-12" if problem == "gap" else "2024-01-05")


def test_continuous_series_that_would_end_early_raise(spark, weekdays):
    days = weekdays("2024-01-01", 9)
    rows = [(c, d, 0.0 if (c, k) == ("M", 2) else 10.0 + k) for c in ("H", "M") for k, d in enumerate(days)]
    table = spark.createDataFrame(rows, "contract string, ts date, price double")
    plan = [("R", days[0], "H"), ("R", days[3], "M")]
    schedule = spark.createDataFrame(plan, "root string, start_ts date, contract string")
    with pytest.raises(ValueError, match="zero price"):
        continuous.continuous_series(table, schedule, "ratio_adjusted")
    assert continuous.continuous_series(table, schedule, "back_adjusted").count() == 9
    assert continuous.continuous_series(table, schedule, "ratio_adjusted", check=False).count() == 3
    absent = spark.createDataFrame([*plan, ("R", days[6], "Z")], schedule.schema)
    with pytest.raises(ValueError, match="no prices"):
        continuous.continuous_series(table, absent, "back_adjusted")


def test_price_column_rules(spark):
    frame = spark.createDataFrame([(1.0, 2.0, "x")], "Last double, ADJ_CLOSE double, note string")
    assert files.price_column(frame) == "ADJ_CLOSE"
    assert files.price_column(spark.createDataFrame([(1.0, "x")], "value double, note string")) == "value"
    with pytest.raises(ValueError):
        files.price_column(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))


def test_universe_rules(spark):
    ok = {"symbol": "ES", "sector": "Equities", "point_value": 50}
    table = universe.load_universe(spark, [ok, {**ok, "symbol": "CL=F", "data_source": "Yahoo"}])
    names = {r.symbol: r.data_symbol for r in universe.vendor_table(table).collect()}
    assert names == {"ES": "ES=F", "CL=F": "CL=F"}
    for bad in ([ok, ok], [{**ok, "point_value": 0}], [{**ok, "sector": ""}], [{**ok, "contract_step": -1}]):
        with pytest.raises(ValueError):
            universe.load_universe(spark, bad)
    for bad in ([{**ok, "tick": 1}], [{"symbol": "ES"}]):
        with pytest.raises(KeyError):
            universe.load_universe(spark, bad)


def test_table_sink_round_trip(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 2).cast("string").alias("run_id"), F.col("id").cast("double").alias("nav"))
    sinks.write_table(rows, str(tmp_path / "nav"))
    assert spark.read.parquet(str(tmp_path / "nav/parquet")).count() == 10
    assert spark.read.csv(str(tmp_path / "nav/csv"), header=True).count() == 10


def test_a_bundle_is_replaced_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bundle")
    numbers = lambda *n: spark.createDataFrame([("r", k) for k in n], "run_id string, n int")
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, path)
    for n in (1, 2, 3):
        where = sinks.write_bundle({"nav": numbers(n)}, numbers(10 * n), numbers(n), path)
        assert [r.n for r in spark.read.parquet(f"{where['nav']}/parquet").collect()] == [n]
        assert [r.n for r in sinks.read_bundle(spark, path)["nav"].collect()] == [n]
    assert len([d for d in os.listdir(path) if d.startswith("version-")]) == 2  # the last one and the one before

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_records", stopped)
        with pytest.raises(RuntimeError):
            sinks.write_bundle({"nav": numbers(99)}, numbers(99), numbers(99), path)
    found = sinks.read_bundle(spark, path)
    assert {name: [r.n for r in table.collect()] for name, table in found.items()} == {"nav": [3], "summary": [30], "scenarios": [3]}
    sinks.write_bundle({"nav": numbers(4)}, numbers(40), numbers(4), path, ("csv",))
    assert [r.n for r in sinks.read_bundle(spark, path)["nav"].collect()] == [4]
    assert len([d for d in os.listdir(path) if d.startswith("version-")]) == 2
