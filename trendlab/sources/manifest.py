"""Which files belong to which instrument, what columns they have and which days they hold."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from urllib.parse import quote

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .local import small_table

SCHEMA = "symbol string, path string, shape string, first date, last date"
_WILD = re.compile(r"[*?\[{\\]")
_HEAD_BYTES = 1 << 16


def price_manifest(spark: SparkSession, instruments: Sequence[Mapping], fmt: str) -> DataFrame:
    """``(symbol, path, shape, first, last)``: a row for each file of each instrument's ``data_symbol``.

    Files of equal ``shape`` have equal columns (Parquet: names and types; CSV: the header line, null without one).
    ``first`` and ``last`` bound the days of a Parquet file by its footer; they are null where it does not say.

    Spark lists the files, in a job of its own where there are many; they find their instrument by a join on the folders above them, and
    tasks open the footers or headers of their share. The workers open files with Arrow, which knows local files, HDFS and the
    usual object stores.
    """
    files = _listed(spark, [str(item["data_symbol"]) for item in instruments])
    home = _home(spark)
    places = small_table(spark, [(i["symbol"], *_place(str(i["data_symbol"]), home)) for i in instruments], "symbol string, above string, pattern string")
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    owned = files.withColumn("above", F.explode(above)).join(places, "above").filter("pattern is null or file rlike pattern")
    read = _parquet_footers if fmt == "parquet" else _csv_headers
    return owned.select("symbol", "path").mapInPandas(read, SCHEMA)


def plain(uri: Column) -> Column:
    """A file's address with one form for local files."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def literal(path: str) -> str:
    """A file's path for a reader that would take wildcards in it."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, file)`` of all files under the paths; their content is not read."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dict.fromkeys(paths)))
    except AnalysisException as exc:
        raise FileNotFoundError(f"price files not found: {exc.getMessage() or exc}") from exc
    return found.select("path", plain(F.col("path")).alias("file"))


def _home(spark: SparkSession) -> str:
    """The working folder against which relative paths stand, with its file system."""
    system = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsparkSession.sessionState().newHadoopConf())
    return system.getWorkingDirectory().toString()


def _place(path: str, home: str) -> tuple[str, str | None]:
    """The last folder (or file) of a path above any wildcard, and a pattern of its files if it has wildcards."""
    split = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)$", re.S)
    system, rest = split.match(path).groups()
    own_system, own_folder = split.match(home).groups()
    if system is None:
        system, rest = own_system, posixpath.join(own_folder, rest)
    elif system.endswith("://") or system.endswith(":"):  # a file system without a name is the default one of its kind
        kind = system.split(":")[0]
        system = own_system if own_system.split(":")[0] == kind else system
    rest = posixpath.normpath("/" + rest.lstrip("/")).rstrip("/")
    full = re.sub("^file:/*(?=/|$)", "file:", system + rest)
    steps = full.split("/")
    wild = next((i for i, step in enumerate(steps) if _WILD.search(step)), None)
    if wild is None:
        return full, None
    return "/".join(steps[:wild]), f"^{re.escape('/'.join(steps[:wild]))}/{_regex('/'.join(steps[wild:]))}(/.*)?$"


def _regex(pattern: str) -> str:
    """A file pattern (``* ? [a-z] [^a-z] {x,y}`` and backslash) as a regular expression."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and (end := pattern.find("]", at + 2)) > 0:
            out.append(pattern[at : end + 1])
            at = end
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out.append("(?:" if c == "{" else ")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        at += 1
    return "".join(out)


def _opener(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@"))


def _rows(batches: Iterable[pd.DataFrame], look) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = [look(*_opener(path)) for path in batch["path"]]
        yield pd.DataFrame(
            {"symbol": batch["symbol"], "path": batch["path"], **{name: [s[i] for s in seen] for i, name in enumerate(("shape", "first", "last"))}}
        )


def _parquet_footers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _rows(batches, _footer)


def _csv_headers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _rows(batches, lambda system, path: (_header(system, path), None, None))


def _footer(system: fs.FileSystem, path: str) -> tuple:
    with system.open_input_file(path) as source:
        found = pq.ParquetFile(source)
        shape = "; ".join(f"{field.name} {field.type}" for field in found.schema_arrow)
        return shape, *_days(found.metadata)


def _days(metadata: pq.FileMetaData) -> tuple[dt.date | None, dt.date | None]:
    """First and last day by the statistics of all row groups; times get a day more on both sides, for any time zone."""
    lows, highs = [], []
    for g in range(metadata.num_row_groups):
        group = metadata.row_group(g)
        of = [group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "date"]
        known = of[0].statistics if of and of[0].physical_type in ("INT32", "INT64") else None
        if known is None or not known.has_min_max or not isinstance(known.min, dt.date):
            return None, None
        wide = dt.timedelta(days=1 if isinstance(known.min, dt.datetime) else 0)
        day = lambda v: v.date() if isinstance(v, dt.datetime) else v
        lows.append(day(known.min) - wide)
        highs.append(day(known.max) + wide)
    return (min(lows), max(highs)) if lows else (None, None)


def _header(system: fs.FileSystem, path: str) -> str | None:
    """The first line that is not blank; None for a file without any."""
    head = b""
    with system.open_input_stream(path, compression="detect") as source:
        while b"\n" not in head.lstrip():
            more = source.read(_HEAD_BYTES)
            if not more:
                break
            head += more
    return head.lstrip().split(b"\n", 1)[0].rstrip().decode("utf-8", "replace") or None
