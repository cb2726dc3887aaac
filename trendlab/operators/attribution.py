"""Where profit, exposure and cost come from.

``positions`` is the dense table ``(run_id, symbol, ts, pos, close, point_value)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import exact_sum, pct_change, rolling, series

KEYS = ("run_id", "symbol")

_BLOCK = 256  # symbols on a side of a tile of the correlation matrix


def _point_value() -> Column:
    return F.coalesce("point_value", F.lit(1.0))


def pnl_contributions(positions: DataFrame) -> DataFrame:
    """``pnl`` per instrument and session: yesterday's position times today's price change."""
    w = series(KEYS)
    moved = F.col("close") - F.lag("close").over(w)
    pnl = F.coalesce(F.lag("pos").over(w) * moved * _point_value(), F.lit(0.0))
    return positions.select(*KEYS, "ts", pnl.alias("pnl"))


def sector_contributions(contributions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sum by sector; instruments without one count as ``Unknown``."""
    rows = contributions.join(sectors.select("symbol", "sector"), "symbol", "left")
    sector = F.coalesce("sector", F.lit("Unknown"))
    return rows.groupBy("run_id", "ts", sector.alias("sector")).agg(exact_sum("pnl").alias("pnl"))


def exposures(positions: DataFrame) -> DataFrame:
    value = F.col("pos") * F.col("close") * _point_value()
    return positions.select(*KEYS, "ts", value.alias("exposure"))


def cost_breakdown(ledger_rows: DataFrame | None, fills: DataFrame | None) -> DataFrame:
    """``(run_id, component, amount)``: ledger totals and fill costs by reason."""
    parts = []
    if ledger_rows is not None:
        totals = ledger_rows.groupBy("run_id").agg(
            exact_sum("trading_cost").alias("ledger_trading"),
            exact_sum("roll_cost").alias("ledger_roll"),
            exact_sum("total_cost").alias("ledger_total"),
        )
        parts.append(totals.unpivot("run_id", ["ledger_trading", "ledger_roll", "ledger_total"], "component", "amount"))
    if fills is not None:
        reason = F.concat(F.lit("trades_"), F.coalesce("reason", F.lit("unknown")))
        parts.append(fills.groupBy("run_id", reason.alias("component")).agg(exact_sum("cost").alias("amount")))
    if not parts:
        raise ValueError("cost breakdown needs a ledger or fills")
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def top_and_other(totals: DataFrame, top_n: int = 10, name: str = "symbol", value: str = "pnl") -> DataFrame:
    """Per run the entries largest in size; beyond ``top_n`` the tail becomes one ``Other`` row."""
    w = Window.partitionBy("run_id")
    order = w.orderBy(F.abs(value).desc(), name)
    ranked = totals.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(w))
    tail = (F.col("_n") > top_n) & (F.col("_rank") >= top_n)
    label = F.when(tail, "Other").otherwise(F.col(name))
    place = F.when(tail, top_n).otherwise(F.col("_rank")).cast("int")
    return ranked.groupBy("run_id", place.alias("place"), label.alias(name)).agg(F.sum(value).alias(value))


def top_exposures(exposure_rows: DataFrame, top_n: int = 5) -> DataFrame:
    """Exposure rows of the instruments with the largest mean size per run."""
    size = exposure_rows.groupBy(*KEYS).agg(F.avg(F.abs("exposure")).alias("_mean"))
    order = Window.partitionBy("run_id").orderBy(F.col("_mean").desc(), "symbol")
    keep = size.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top_n)
    rows = exposure_rows.join(keep.select(*KEYS), [*KEYS], "left_semi")
    return rows.withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))


def sector_allocation(positions: DataFrame, sectors: DataFrame, capital: float) -> DataFrame:
    """Absolute notional weight by sector and session."""
    weight = F.abs(F.col("pos") * F.col("close") * _point_value() / capital)
    rows = positions.join(sectors.select("symbol", "sector"), "symbol", "left")
    return rows.groupBy("run_id", "ts", "sector").agg(F.sum(weight).alias("allocation"))


def contract_turnover(positions: DataFrame, window: int = 21) -> DataFrame:
    """Contracts traded per session and their trailing mean."""
    change = F.abs(F.col("pos") - F.lag("pos").over(series(KEYS)))
    daily = (
        positions.withColumn("_d", F.coalesce(change, F.lit(0.0)))
        .groupBy("run_id", "ts")
        .agg(F.sum("_d").alias("turnover"))
    )
    return daily.withColumn("turnover_mean", rolling(F.avg, "turnover", ["run_id"], window))


def cumulative(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Running sums ``cum_<column>`` along each series."""
    frame = series(keys).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(c).over(frame).alias(f"cum_{c}") for c in columns])


def return_correlation(prices: DataFrame) -> DataFrame:
    """Pearson correlation ``(run_id, symbol_a, symbol_b, corr)`` over dates complete in all symbols.

    The matrix is tiled: the symbols of a run are numbered and cut into blocks of ``_BLOCK``, a date becomes one short
    vector per block (a strip), and a task owns a pair of blocks and reads the strips of these two alone, date by date. It holds the
    cross products of one tile, whatever the width of the universe; a strip goes to as many tiles as there are blocks. Only
    tiles on and above the diagonal are computed, mirror images are added at the end.
    """
    size = _BLOCK
    returns = prices.withColumn("ret", pct_change("close", KEYS))
    first = Window.partitionBy("run_id", "symbol").orderBy("ts")
    returns = returns.withColumn("_first", F.row_number().over(first) == 1).filter("not _first and ret is not null")
    numbered = Window.partitionBy("run_id")  # a row per symbol
    names = prices.select("run_id", "symbol").distinct().select(
        "run_id", "symbol", (F.row_number().over(numbered.orderBy("symbol")) - 1).alias("pos"), F.count("*").over(numbered).alias("_width")
    )
    rows = returns.join(names, ["run_id", "symbol"])
    strips = rows.groupBy("run_id", "ts", F.floor(F.col("pos") / size).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ret"))).alias("v"), F.first("_width").alias("_width")
    )
    # strips of a date that hold all symbols together
    known = F.sum(F.size("v")).over(Window.partitionBy("run_id", "ts"))
    strips = strips.withColumn("_known", known).filter("_known = _width").withColumn("_last", F.floor((F.col("_width") - 1) / size).cast("int"))
    tile = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    b = F.col("block")
    right = F.transform(F.sequence(b, F.col("_last")), lambda j: tile(b, j, 0))
    down = F.filter(F.transform(F.sequence(F.lit(0), b), lambda i: tile(i, b, 1)), lambda t: t["i"] < t["j"])
    dealt = strips.select("run_id", "ts", F.col("v.ret").alias("rets"), F.explode(F.concat(right, down)).alias("t")).select("run_id", "t.i", "t.j", "ts", "t.side", "rets")
    ordered = dealt.repartition("run_id", "i", "j").sortWithinPartitions("run_id", "i", "j", "ts", "side").drop("ts")

    def finished(key: tuple, sums: list) -> pa.RecordBatch:
        run, i, j = key
        n, left, right, left_squares, right_squares, cross = sums
        at, to = np.nonzero(np.triu(np.ones(cross.shape, bool)) if i == j else np.ones(cross.shape, bool))
        spread = lambda total, squares: np.sqrt(np.maximum(n * squares - total**2, 0.0))
        scale = spread(left, left_squares)[at] * spread(right, right_squares)[to]
        corr = np.divide(n * cross[at, to] - left[at] * right[to], scale, out=np.full(len(at), np.nan), where=scale > 0)
        columns = [pa.array([run] * len(at), pa.string()), pa.array(i * size + at), pa.array(j * size + to), pa.array(corr, from_pandas=True)]
        return pa.RecordBatch.from_arrays(columns, names=["run_id", "a", "b", "corr"])

    def cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, waiting = None, [], None
        for batch in batches:
            runs, i, j = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sides, lists = batch.column(3).to_numpy(), batch.column(4)
            keys = list(zip(runs, i.tolist(), j.tolist(), strict=True))
            edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if keys[start] != key:
                    if key is not None:
                        yield finished(key, sums)
                    key, sums, waiting = keys[start], [0, 0.0, 0.0, 0.0, 0.0, 0.0], None
                side, part = sides[start:stop], lists.slice(start, stop - start)

                def matrix(chosen: np.ndarray, part: pa.Array = part) -> np.ndarray:
                    picked = part.filter(pa.array(chosen))
                    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), -1)

                left = matrix(side == 0) if (side == 0).any() else np.zeros((0, 0))
                if key[1] == key[2]:
                    right = left
                else:  # a left strip whose right one is in the next batch waits for it
                    left = left if waiting is None else np.concatenate([waiting, left]) if len(left) else waiting
                    right = matrix(side == 1) if (side == 1).any() else np.zeros((0, 0))
                    waiting = left[len(right) :] if len(left) > len(right) else None
                    left = left[: len(right)]
                if len(left):
                    more = (len(left), left.sum(axis=0), right.sum(axis=0), (left * left).sum(axis=0), (right * right).sum(axis=0), left.T @ right)
                    sums = [s + m for s, m in zip(sums, more, strict=True)]
        if key is not None:
            yield finished(key, sums)

    half = ordered.mapInArrow(cross_products, "run_id string, a long, b long, corr double")
    pairs = half.select("run_id", "corr", F.explode(F.filter(F.array(F.struct("a", "b"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), lambda p: p.isNotNull())).alias("p"))
    of = lambda x: names.select("run_id", F.col("pos").cast("long").alias(x), F.col("symbol").alias(f"symbol_{x}"))
    named = pairs.select("run_id", "p.a", "p.b", "corr").join(of("a"), ["run_id", "a"]).join(of("b"), ["run_id", "b"])
    return named.select("run_id", "symbol_a", "symbol_b", "corr")
