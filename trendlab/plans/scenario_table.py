"""Scenarios as a table that the plan makes: no object per scenario on the driver.

The driver holds what the user wrote down, one literal per value of each grid setting; the combinations are rows. A row carries its
flat settings as a map from dotted name to text, overlaid in the plan, and typed columns read from it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.local import small_table
from ..sources.sinks import stored
from .scenarios import FIELDS, fingerprint, flatten, sections, settings_of

_MAP = "map<string,string>"
#: Combinations that one task makes of what is left of the grid.
ROWS_PER_TASK = 50_000


def _text(value) -> str | None:
    """A setting's value as text: plain for text and dates, JSON for all else."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(list(value) if isinstance(value, tuple) else value, default=str)


def _plain(value) -> str | None:
    """Dates as ISO text, not as a JSON string of it."""
    text = _text(value)
    return text[1:-1] if text and text.startswith('"') and not isinstance(value, str) else text


def _literal(settings: Mapping) -> Column:
    items = [F.lit(part).cast("string") for name, value in settings.items() for part in (name, _plain(value))]
    return (F.create_map(*items) if items else F.expr("map()")).cast(_MAP)


def _as_json(settings: Mapping) -> dict[str, str]:
    return {name: json.dumps(value, default=str) for name, value in settings.items()}


def overlay(base: Column, new: Column) -> Column:
    """Settings of two maps, the second first in force; the rule is that of :func:`settings_of`."""
    names = F.map_keys(new)
    hides = lambda k: F.exists(names, lambda n: (k == n) | F.startswith(k, F.concat(n, F.lit("."))) | F.startswith(n, F.concat(k, F.lit("."))))
    return F.map_concat(F.map_filter(base, lambda k, _: ~hides(k)), new)


def _read(settings: Column, dotted: str, kind: str) -> Column:
    """One setting as a typed value, null where it is absent or null."""
    text = F.element_at(settings, dotted)
    if kind == "map<string,double>":
        prefix = f"{dotted}."
        below = F.map_filter(settings, lambda k, _: F.startswith(k, F.lit(prefix)))
        named = F.transform_keys(below, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
        return F.when(F.size(below) > 0, F.transform_values(named, lambda _, v: v.cast("double")))
    if kind == "array<int>":
        return F.transform(F.from_json(text, "array<double>"), lambda v: v.cast("int"))
    if kind == "date":
        return F.substring(text, 1, 10).cast("date")
    return text.cast("double").cast("int") if kind == "int" else text.cast(kind)


def _typed(settings: Column) -> list[Column]:
    out = []
    for column, dotted, kind, default in FIELDS:
        found = F.coalesce(*[_read(settings, d, kind) for d in dotted])
        if default is not None:
            usual = F.array(*[F.lit(v) for v in default]) if isinstance(default, tuple) else F.lit(default)
            if column == "gross_limit":  # named without a value: no limit
                usual = F.when(~F.map_contains_key(settings, "risk.gross_exposure_limit"), usual)
            found = F.coalesce(found, usual.cast(kind))
        out.append(found.alias(column))
    return out


def _check(table: DataFrame) -> None:
    """Raise for the first scenario with a setting that can't be."""
    faults = {
        "backtest.start or backtest.end is not set; set both": F.col("start").isNull() | F.col("end").isNull(),
        "signals.momentum.lookbacks has a number that is not above 0": F.exists("lookbacks", lambda lb: F.coalesce(lb <= 0, F.lit(True))),
        "risk.vol_model is neither 'ewma' nor 'rolling'": ~F.col("vol_model").isin("ewma", "rolling"),
        "no allocator has the name in risk.risk_allocator": ~F.col("risk_allocator").isin("proportional", "erc", "equal_active"),
    }
    fault = F.coalesce(*[F.when(wrong, F.lit(text)) for text, wrong in faults.items()])
    bad = table.select("run_id", fault.alias("fault")).filter("fault is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['run_id']}: {bad[0]['fault']}")


def scenario_table(
    spark: SparkSession,
    config: Mapping,
    grid: Mapping[str, Sequence] | None = None,
    base_overrides: Mapping | None = None,
    splits: Iterable[Mapping] | DataFrame | None = None,
    seeds: Sequence[int] | int | None = None,
) -> DataFrame:
    """The scenarios of ``scenario_list`` as rows: ``run_id``, ``fold``, typed settings, overrides, seed and fingerprint.

    Numbers are worked out from positions: the seed varies fastest, then the last grid setting; splits vary slowest. ``splits`` may be a
    table ``(fold, start, end)``. Written once, so that its size is known where runs join it.
    """
    grid = {name: list(values) for name, values in (grid or {}).items()}
    draws = list(seeds) if isinstance(seeds, Sequence) else [seeds]
    if splits is None or isinstance(splits, DataFrame):
        windows = splits if splits is not None else small_table(spark, [(1, None, None)], "fold int, start string, end string")
    else:
        edges = [tuple(str(s[e])[:10] if s.get(e) else None for e in ("start", "end")) for s in splits] or [(None, None)]
        windows = small_table(spark, [(i, *e) for i, e in enumerate(edges, 1)], "fold int, start string, end string")
    rows = windows.select(F.col("fold").cast("int").alias("fold"), F.col("start").cast("string").alias("_a"), F.col("end").cast("string").alias("_b"))
    empty = F.expr("map()").cast(_MAP)
    rows = rows.withColumn("_point", empty).withColumn("_json", empty).withColumn("_place", F.lit(0).cast("long"))
    spread = -(-prod(len(v) for v in grid.values()) * len(draws) // ROWS_PER_TASK)
    for name, values in grid.items():
        points = [F.struct(_literal(flatten({name: v})).alias("text"), _literal(_as_json(flatten({name: v}))).alias("json")) for v in values]
        array = F.array(*points) if points else F.array().cast(f"array<struct<text:{_MAP},json:{_MAP}>>")
        rows = rows.select("fold", "_a", "_b", "_point", "_json", "_place", F.posexplode(array).alias("_at", "_new"))
        rows = rows.withColumn("_point", overlay(F.col("_point"), F.col("_new.text"))).withColumn("_json", overlay(F.col("_json"), F.col("_new.json")))
        rows = rows.withColumn("_place", F.col("_place") * len(values) + F.col("_at"))
        if spread > 1 and len(values) > 1:
            rows = rows.repartition(min(spread, 10_000), "fold", "_place")
    rows = rows.select("fold", "_a", "_b", "_point", "_json", "_place", F.posexplode(F.array(*[F.lit(d).cast("int") for d in draws])).alias("_at", "run_seed"))
    per_fold = prod(len(v) for v in grid.values()) * len(draws)
    number = (F.col("fold") - 1).cast("long") * per_fold + F.col("_place") * len(draws) + F.col("_at") + 1
    own = F.map_filter(
        F.create_map(F.lit("backtest.start"), F.substring("_a", 1, 10), F.lit("backtest.end"), F.substring("_b", 1, 10), F.lit("backtest.seed"), F.col("run_seed").cast("string")),
        lambda _, v: v.isNotNull(),
    )
    settings = overlay(overlay(_literal(settings_of(config, base_overrides)), F.col("_point")), own)
    # Four digits, more where the number has more.
    digits = F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    rows = rows.select(F.concat(F.lit("run-"), digits).alias("run_id"), "fold", "run_seed", F.col("_json").alias("grid_settings"), settings.alias("_settings"))
    rows = rows.select("run_id", "fold", *_typed(F.col("_settings")), "grid_settings", "run_seed")
    table = stored(rows.withColumn("config_hash", fingerprint(rows, exclude=("run_id", "fold", "grid_settings", "run_seed"))), "scenarios")
    _check(table)
    return table


def table_metadata(table: DataFrame, base_overrides: Mapping | None = None) -> DataFrame:
    """Overrides (JSON), seed and fingerprint per run of a :func:`scenario_table`."""
    base = flatten(base_overrides)

    @F.pandas_udf("grid_overrides string, base_overrides string, combined_overrides string")
    def shown(points: pd.Series) -> pd.DataFrame:
        text = lambda settings: json.dumps(sections(settings), sort_keys=True, default=str)
        read = [{name: json.loads(value) for name, value in json.loads(p).items()} for p in points]
        rows = [(text(p), text(base), text(settings_of(base, p))) for p in read]
        return pd.DataFrame(rows, columns=["grid_overrides", "base_overrides", "combined_overrides"])

    rows = table.select("run_id", shown(F.to_json("grid_settings")).alias("o"), F.col("run_seed").alias("seed"), "config_hash")
    return rows.select("run_id", "o.*", "seed", "config_hash")


def numbered_rows(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order``, which must be total, without bringing them to one task.

    Rows are sorted by ranges and written with their place inside their range; the sizes of the ranges before, one row each, are added.
    """
    split = 1 << 33  # the generated id counts inside a partition below this bit and numbers partitions above it
    placed = stored(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part, place = F.floor(F.col("_id") / split).cast("int"), (F.col("_id") % split)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = small_table(rows.sparkSession, offsets, "_part int, _before long")
    ranked = placed.withColumn("_part", part).join(table, "_part")
    return ranked.withColumn(name, (F.col("_before") + place + 1).cast("int" if before < 1 << 31 else "long")).drop("_part", "_before", "_id")
