"""Moving-block bootstrap of return series, as joins and aggregates.

``returns(run_id, idx, ret)`` numbers the finite returns of each run from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import TRADING_DAYS, ratio
from ..sources.sinks import stored

METRICS = ("sharpe", "max_drawdown")
_SAMPLE = ("run_id", "sample")


def indexed_returns(rows: DataFrame, value: str = "ret") -> DataFrame:
    """Number the finite returns of each run by date."""
    r = F.col(value)
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf"))
    order = Window.partitionBy("run_id").orderBy("ts")
    return rows.filter(finite).select("run_id", (F.row_number().over(order) - 1).alias("idx"), r.alias("ret"))


def _random_start(seed: int) -> Callable[[Column, Column, Column], Column]:
    """The first 32 bits of an MD5 of seed, sample and block: other engines can draw the same."""

    def start(sample: Column, block: Column, choices: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), block.cast("string")).cast("binary"))
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), choices)

    return start


def block_samples(
    returns: DataFrame,
    block_size: int = 20,
    n_samples: int = 1_000,
    seed: int = 0,
    start_of: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """``(run_id, sample, path)``: every sample as an array as long as its source, built from random blocks.

    A run's returns are one array (as long as its trading days).  Copies of it go out to groups of
    samples, and each sample cuts its blocks from that copy, so the drawn values are never shuffled.
    Block starts are a hash of (seed, sample, block): a lost task draws the same sample again.
    ``start_of(sample, block, choices)`` replaces the generator.
    """
    if block_size <= 0:
        raise ValueError(f"blocks of {block_size} returns cannot fill a sample")
    start_of = start_of or _random_start(seed)
    source = returns.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ret"))).alias("_rows"))
    source = source.select("run_id", F.col("_rows.ret").alias("_ret"))
    per_group = 25
    groups = source.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit((n_samples - 1) // per_group))))
    # An explicit number of partitions: the copies are small, the work that follows is not.
    tasks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(tasks, "run_id", "_group")
    first = F.col("_group") * per_group
    last = F.least(first + per_group, F.lit(n_samples)) - 1
    rows = groups.select("run_id", F.explode(F.sequence(first, last)).alias("sample"), "_ret")

    n = F.size("_ret").cast("long")
    b = F.least(F.lit(block_size).cast("long"), n)
    sample = F.col("sample").cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(n / b) - 1),
        lambda k: F.slice("_ret", start_of(sample, k, n - b + 1).cast("int") + 1, b.cast("int")),
    )
    return rows.select("run_id", "sample", F.slice(F.flatten(blocks), 1, F.size("_ret")).alias("path"))


def sample_rows(samples: DataFrame) -> DataFrame:
    """The samples as rows ``(run_id, sample, pos, ret)``."""
    return samples.select("run_id", "sample", F.posexplode("path").alias("pos", "ret"))


def _drawdown(path: Column) -> Column:
    """Deepest fall of a compounded path from its running peak, which starts at the first compounded value."""
    zero = F.lit(0.0)
    # (value, peak, deepest) after each day; the peak before the first day is below any value
    start = F.struct(F.lit(1.0).alias("nav"), zero.alias("peak"), zero.alias("fall"))

    def step(acc: Column, r: Column) -> Column:
        nav = acc["nav"] * (1 + r)
        peak = F.greatest(acc["peak"], nav)
        return F.struct(
            nav.alias("nav"), peak.alias("peak"), F.least(acc["fall"], F.coalesce(ratio(nav, peak) - 1, zero)).alias("fall")
        )

    return F.aggregate(path, start, step, lambda acc: acc["fall"])


def sample_stats(samples: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(run_id, sample, <metric>...)``, each folded over the sample's own array: no shuffle.

    The drawdown is the deepest fall of the compounded sample from its running peak, which starts at
    the first compounded value.
    """
    zero = F.lit(0.0)
    n = F.size("path")
    out = {}
    if "sharpe" in metrics:
        mean = F.aggregate("path", zero, lambda acc, r: acc + r) / n
        samples = samples.withColumn("_mean", mean)
        squares = F.aggregate("path", zero, lambda acc, r: acc + (r - F.col("_mean")) * (r - F.col("_mean")))
        std = F.sqrt(squares / F.nullif(n - 1, F.lit(0)))
        out["sharpe"] = F.coalesce(ratio(F.col("_mean") * TRADING_DAYS**0.5, std), zero)
    if "max_drawdown" in metrics:
        out["max_drawdown"] = _drawdown(F.col("path"))
    return samples.select(*_SAMPLE, *[out[m].alias(m) for m in metrics])


#: Samples that read one copy of a run's block summaries.
_PER_GROUP = 100


def _falls(path: Column, first: Column, length: Column) -> Column:
    """What a block does to a compounding value: ``total`` growth, ``low``est value after any of its days, and the
    ``deep``est ratio of a value to the highest one so far inside the block; ``high`` is that highest value.
    """
    start = F.struct(F.lit(1.0).alias("total"), F.lit(0.0).alias("high"), F.lit(float("inf")).alias("low"), F.lit(1.0).alias("deep"))

    def step(acc: Column, r: Column) -> Column:
        total = acc["total"] * (1 + r)
        high = F.greatest(acc["high"], total)
        return F.struct(
            total.alias("total"), high.alias("high"), F.least(acc["low"], total).alias("low"),
            F.least(acc["deep"], F.coalesce(ratio(total, high), F.lit(1.0))).alias("deep"),
        )

    return F.aggregate(F.slice(path, first.cast("int") + 1, length.cast("int")), start, step)


def block_stats(
    returns: DataFrame,
    metrics: Sequence[str] = METRICS,
    block_size: int = 20,
    n_samples: int = 1_000,
    seed: int = 0,
    start_of: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """``(run_id, sample, <metric>...)`` of the samples that :func:`block_samples` draws, without building them.

    A sample is a sequence of blocks, so it costs its blocks and not its days. Sums and squares of a block are differences of
    running sums about the run's mean. A drawdown merges: with a value v and a peak p before the block, its deepest ratio is
    ``min(deep, v * low / p)``, since x / max(a, b) is the smaller of x / a and x / b. That holds while values are not
    negative; a run that loses more than everything on a day is folded day by day. The last block is as short as the
    sample's length asks. A run without returns has no sample.
    """
    if block_size <= 0:
        raise ValueError(f"blocks of {block_size} returns cannot fill a sample")
    start_of = start_of or _random_start(seed)
    run = Window.partitionBy("run_id")
    upto = run.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    centred = returns.withColumn("_m", F.avg("ret").over(run)).withColumn("_x", F.col("ret") - F.col("_m"))
    sums = centred.select("run_id", "idx", "ret", "_m", F.sum("_x").over(upto).alias("c1"), F.sum(F.col("_x") * F.col("_x")).over(upto).alias("c2"))
    source = sums.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "ret", "c1", "c2"))).alias("_rows"), F.first("_m").alias("_mean"), F.min("ret").alias("_worst")
    )
    n = F.size("_rows").cast("long")
    source = source.select("run_id", "_mean", "_worst", "_rows", n.alias("_n"), F.least(F.lit(block_size).cast("long"), n).alias("_b"), F.col("_rows.ret").alias("_ret"))
    source = source.withColumn("_k", F.ceil(F.col("_n") / F.col("_b"))).withColumn("_rest", F.col("_n") - (F.col("_k") - 1) * F.col("_b"))

    def blocks(length: Column) -> Column:
        at = lambda c, i: F.when(i < 0, F.lit(0.0)).otherwise(F.get("_rows", i.cast("int"))[c])
        moment = lambda c, s: at(c, s + length - 1) - at(c, s - 1)
        value = lambda s: F.struct(moment("c1", s).alias("s1"), moment("c2", s).alias("s2"))
        if "max_drawdown" in metrics:
            value = lambda s: F.struct(moment("c1", s).alias("s1"), moment("c2", s).alias("s2"), _falls(F.col("_ret"), s, length).alias("f"))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.col("_b")), value)

    summed = source.select(
        "run_id", "_mean", "_n", "_b", "_k", blocks(F.col("_b")).alias("_full"), blocks(F.col("_rest")).alias("_last"),
        F.when(F.col("_worst") < -1, F.col("_ret")).alias("_odd"),
    )
    groups = summed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit((n_samples - 1) // _PER_GROUP))))
    tasks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(tasks, "run_id", "_group")
    first = F.col("_group") * _PER_GROUP
    rows = groups.withColumn("sample", F.explode(F.sequence(first, F.least(first + _PER_GROUP, F.lit(n_samples)) - 1)))
    sample, choices = F.col("sample").cast("long"), F.col("_n") - F.col("_b") + 1

    def block(k: Column) -> Column:
        at = start_of(sample, k, choices).cast("int")
        return F.when(k < F.col("_k") - 1, F.get("_full", at)).otherwise(F.get("_last", at))

    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), block)
    rows = rows.select(*_SAMPLE, "_mean", "_n", "_b", "_k", "_odd", drawn.alias("_drawn"))
    zero, out = F.lit(0.0), {}
    if "sharpe" in metrics:
        total = lambda c: F.aggregate("_drawn", zero, lambda acc, x: acc + x[c])
        rows = rows.withColumn("_s1", total("s1")).withColumn("_s2", total("s2"))
        squares = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n"), zero)
        # what lies within the rounding of the sums is no dispersion
        noise = 1e-14 * F.col("_s2") + 1e-28 * F.col("_mean") * F.col("_mean") * F.col("_n")
        std = F.sqrt(F.when(squares > noise, squares).otherwise(0.0) / F.nullif(F.col("_n") - 1, F.lit(0)))
        out["sharpe"] = F.coalesce(ratio((F.col("_mean") + F.col("_s1") / F.col("_n")) * TRADING_DAYS**0.5, std), zero)
    if "max_drawdown" in metrics:
        start = F.struct(F.lit(1.0).alias("v"), zero.alias("peak"), F.lit(1.0).alias("deep"))

        def merge(acc: Column, x: Column) -> Column:
            f = x["f"]
            before = F.when(acc["peak"] > 0, acc["v"] * f["low"] / acc["peak"])
            inside = F.when(acc["v"] > 0, f["deep"])
            return F.struct(
                (acc["v"] * f["total"]).alias("v"), F.greatest(acc["peak"], acc["v"] * f["high"]).alias("peak"),
                F.least(acc["deep"], before, inside).alias("deep"),
            )

        merged = F.aggregate("_drawn", start, merge, lambda acc: acc["deep"] - 1)
        spans = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("_k") - 1),
            lambda k: F.slice("_odd", start_of(sample, k, choices).cast("int") + 1, F.col("_b").cast("int")),
        )
        out["max_drawdown"] = F.when(F.col("_odd").isNull(), merged).otherwise(_drawdown(F.slice(F.flatten(spans), 1, F.col("_n").cast("int"))))
    return rows.select(*_SAMPLE, *[out[m].alias(m) for m in metrics])


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float], bins: int = 1024) -> DataFrame:
    """``(*keys, <name>...)``: interpolated percentiles of ``value``, exact for any number of rows in a group.

    A first pass counts values in ``bins`` equal bins between the group's extremes; running counts name the bins that hold
    the wanted ranks. A second pass keeps the values of those bins alone and counts them value by value. No buffer holds a
    group: what is ordered together are the bins, then the distinct values of one bin. Nulls are left out.
    """
    keys = list(keys)
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = known.join(edges, keys).withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    counted = counted.withColumn("_below", F.coalesce(F.sum("_c").over(by_bin), F.lit(0)))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), edge(place(p)).cast("long").alias("rank")) for name, p in at.items() for side, edge in (("lower", F.floor), ("upper", F.ceil))])
    wanted = counted.select(*keys, "_bin", "_n", "_below", "_c", F.explode(ranks).alias("w")).filter("w.rank >= _below and w.rank < _below + _c")
    wanted = wanted.select(*keys, "_bin", "_n", "_below", "w.*")
    chosen = placed.join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_m"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("_before", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    hit = wanted.join(chosen, [*keys, "_bin"]).filter((F.col("rank") - F.col("_below")).between(F.col("_before"), F.col("_before") + F.col("_m") - 1))
    wide = hit.groupBy(*keys).agg(
        F.first("_n").alias("_n"), *[F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_v"))).alias(f"_{side}_{name}") for name in at for side in ("lower", "upper")]
    )
    between = lambda name, p: F.col(f"_lower_{name}") + (F.col(f"_upper_{name}") - F.col(f"_lower_{name}")) * (place(p) - F.floor(place(p)))
    return wide.select(*keys, *[between(name, p).alias(name) for name, p in at.items()])


def confidence_intervals(
    returns: DataFrame,
    metrics: Sequence[str] = METRICS,
    n_samples: int = 1_000,
    block_size: int = 20,
    ci: float = 0.95,
    seed: int = 0,
    start_of: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """``(run_id, metric, mean, lower, upper)`` with exact, interpolated percentiles."""
    names = [m.lower() for m in metrics]
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise KeyError(f"unsupported metrics {unknown}; available: {list(METRICS)}")
    stats = block_stats(returns, names, block_size, n_samples, seed, start_of)
    values = stored(stats.unpivot("run_id", names, "metric", "value"), "sample-stats")
    if values.isEmpty():
        raise ValueError("a bootstrap needs at least one finite return")
    tail = (1 - ci) / 2
    means = values.groupBy("run_id", "metric").agg(F.avg("value").alias("mean"))
    return means.join(exact_percentiles(values, ["run_id", "metric"], "value", {"lower": tail, "upper": 1 - tail}), ["run_id", "metric"])
