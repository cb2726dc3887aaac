"""Price files to the long table ``(symbol, ts, close)``."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scaling import nan_to_null
from ..operators.calendar import align, validate
from ..operators.quality import assert_clean
from .local import small_table
from .manifest import literal, plain, price_manifest
from .sinks import stored

logger = logging.getLogger(__name__)

# Accepted names of the price column, first match wins, case-insensitive.
PRICE_COLUMNS = ("settle", "close", "adj_close", "price", "last")

FORMATS = ("csv", "parquet")

# Words that stand for a missing price in CSV files, in any case.
MISSING_WORDS = ("", "-", "#n/a", "n/a", "<na>", "na", "nan", "-nan", "null", "none")


def price_column(frame: DataFrame) -> str:
    """The price column of a file: a known name, else the only numeric column."""
    by_name = {c.lower(): c for c in frame.columns}
    for name in PRICE_COLUMNS:
        if name in by_name:
            return by_name[name]
    numeric = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(numeric) == 1:
        return numeric[0]
    raise ValueError(f"no price column among {frame.columns}; expected one of {PRICE_COLUMNS}")


def adjusted_close(frame: DataFrame) -> str:
    """``Adj Close`` where the vendor table has such a column, else ``Close`` (not row by row)."""
    for name in ("Adj Close", "Close"):
        if name in frame.columns:
            return name
    raise KeyError("vendor table has no 'Close' column")


def read_prices(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str,
    start=None,
    end=None,
    symbol_column: str | None = None,
    column: str | None = None,
) -> DataFrame:
    """``(path, ts, close)``, or ``(symbol, ts, close)`` when the files carry a symbol column.

    Dates are bounded on both ends, inclusive; on Parquet the bounds and the two columns reach the
    scan.  Files need a ``date`` column.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported price format: {fmt}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    frame = _open(spark, paths, fmt)
    if "date" not in frame.columns:
        raise ValueError(f"price files need a 'date' column, found {frame.columns}")
    value = column or _resolve_column(spark, paths, fmt, frame)
    day = F.to_date("date") if fmt == "csv" else F.col("date")  # the bare column reaches the Parquet scan
    if start is not None:
        frame = frame.filter(day >= F.lit(str(start)[:10]).cast("date"))
    if end is not None:
        # the bound is a day: times inside the last day still count
        frame = frame.filter(day < F.date_add(F.lit(str(end)[:10]).cast("date"), 1))
    name = F.col(symbol_column).alias("symbol") if symbol_column else F.input_file_name().alias("path")
    price = F.col(value)
    if fmt == "csv":  # any other text that is no number still fails
        price = F.when(~F.lower(F.trim(value)).isin(*MISSING_WORDS), price)
    return frame.select(name, F.to_date("date").alias("ts"), nan_to_null(price).alias("close"))


def combine_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of price tables; a symbol found in several keeps the rows of the first one only."""
    ranked = None
    for rank, frame in enumerate(sources):
        part = frame.select("symbol", "ts", "close").withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        raise ValueError("no price sources")
    owner = ranked.groupBy("symbol").agg(F.min("_rank").alias("_rank"))
    return ranked.join(owner, ["symbol", "_rank"], "left_semi").select("symbol", "ts", "close")


def load_universe_prices(
    spark: SparkSession, instruments: Sequence[Mapping], start=None, end=None
) -> DataFrame:
    """Read every instrument from its own source (``data_source`` csv or parquet, path ``data_symbol``).

    A manifest of all files is made by one job; files of equal columns share a scan, and Parquet files whose footers
    place them outside the dates are not opened again.  Rows find their symbol by file.  A path may be relative,
    hold ``..`` or wildcards, and name a file or a folder of any depth.  Unknown sources are skipped with a warning;
    a missing path raises, and so does an instrument whose path holds no file.  A file of blank lines has no rows, one
    of no bytes counts as none.
    """
    symbols = [item["symbol"] for item in instruments]
    if repeated := {s for s in symbols if symbols.count(s) > 1}:
        raise ValueError(f"instruments listed twice: {sorted(repeated)}")
    by_format: dict[str, list[Mapping]] = {}
    for item in instruments:
        by_format.setdefault(str(item.get("data_source", "yahoo")).lower(), []).append(item)
    frames = []
    for fmt, items in by_format.items():
        if fmt not in FORMATS:
            logger.warning("unsupported data source %r skipped", fmt)
            continue
        for item in items:
            if not item.get("data_symbol"):
                raise ValueError(f"instrument {item['symbol']!r} needs data_symbol for source {fmt}")
        found = price_manifest(spark, items, fmt).collect()  # as many rows as the scans list files
        if without := sorted({i["symbol"] for i in items} - {f["symbol"] for f in found}):
            raise FileNotFoundError(f"no price file for instruments {without}")
        # Files may differ in their price column, so those of equal columns share a scan.
        shapes: dict[str, list] = {}
        for file in found:
            if file["shape"] is not None and _may_hold(file, start, end):
                shapes.setdefault(file["shape"], []).append(file)
        for same in shapes.values():
            paths = [literal(path) for path in dict.fromkeys(file["path"] for file in same)]
            owners = small_table(spark, [(file["path"], file["symbol"]) for file in same], "path string, symbol string")
            frames.append(_named(read_prices(spark, paths, fmt, start, end), owners))
    if not frames:
        return small_table(spark, [], "symbol string, ts date, close double")
    return reduce(DataFrame.unionByName, frames)  # each symbol has one source, so no row competes with another


def _may_hold(file, start, end) -> bool:
    """Whether a file of the manifest may hold days of ``[start, end]``; one of unknown days may."""
    late = end is not None and file["first"] is not None and str(file["first"]) > str(end)[:10]
    return not (late or (start is not None and file["last"] is not None and str(file["last"]) < str(start)[:10]))


def _open(spark: SparkSession, paths: Sequence[str], fmt: str, infer: bool = False) -> DataFrame:
    """The files as a table; CSV columns stay text unless ``infer``, so only the header is read here."""
    try:
        if fmt == "csv":
            return spark.read.csv(list(paths), header=True, inferSchema=infer, recursiveFileLookup=True)
        return spark.read.parquet(*paths, recursiveFileLookup=True)
    except AnalysisException as exc:
        raise FileNotFoundError(f"price files {list(paths)} not found") from exc


def _resolve_column(spark: SparkSession, paths: Sequence[str], fmt: str, frame: DataFrame) -> str:
    """The price column by name; only a CSV file without a known name is read for its types."""
    if fmt == "csv" and not {c.lower() for c in frame.columns} & set(PRICE_COLUMNS):
        frame = _open(spark, paths, fmt, infer=True)
    return price_column(frame)


def _named(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows under the symbols that own their file; the scan tells its files percent-encoded."""
    file = plain(F.url_decode(F.regexp_replace("path", r"\+", "%2B")))
    owned = owners.select(plain(F.col("path")).alias("file"), "symbol")
    return rows.withColumn("file", file).join(owned, "file").select("symbol", "ts", "close")


def load_panel(
    spark: SparkSession,
    instruments: Sequence[Mapping],
    start,
    end,
    holidays=None,
    min_price: float | None = 0.0,
    max_consecutive_missing: int = 3,
) -> DataFrame:
    """Prices of all instruments, checked, aligned to the sessions of ``[start, end]`` and checked again.

    The prices as read must have one row per instrument and day and no price at or below ``min_price``; the aligned
    panel, before gaps are filled, no gap of more than ``max_consecutive_missing`` sessions, and some price for each
    instrument.  The rows that were read are written once, as every check and the panel start from them.
    """
    raw = stored(load_universe_prices(spark, instruments, start, end), "prices")
    assert_clean(raw.where("close is not null"), min_price, max_consecutive_missing=-1)
    validate(raw)
    present = {r["symbol"] for r in raw.where("close is not null").select("symbol").distinct().collect()}  # at most the instruments
    if silent := sorted({i["symbol"] for i in instruments if str(i.get("data_source", "")).lower() in FORMATS} - present):
        raise ValueError(f"instruments without a price between {start} and {end}: {silent}")
    assert_clean(align(raw, start, end, holidays, fill=False), min_price, max_consecutive_missing)
    return align(raw, start, end, holidays)
