"""URL rules by a sort-merge range join over reversed hosts, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlab.llm.common import lower_ascii, tasks
from trendlab.sources.sinks import stored

#: (verdict, host, path) of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """The key that sorts a host right before its subdomains: labels from the last one on, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")


def _stacks(rules: DataFrame) -> DataFrame:
    """For each host with rules: its key and the stack when the sweep opens it (its own rules and those it is nested in).

    A stack is as long as the rules along one host, not as the table.
    """
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        "path",
        reversed_host(F.col("host")).alias("key"),
    )
    own = rules.select(entry.alias("e")).groupBy("e.key").agg(F.collect_set("e").alias("own"))
    labels = F.split(F.col("key"), r"\.")  # ends in an empty label, after the last dot
    depths = F.sequence(F.lit(1), F.size(labels) - 1)
    above = own.select("key", F.explode(F.transform(depths, lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))).alias("up"))
    return (
        above.join(own.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of every row of ``pages``.

    A host's rules fill the interval of keys that begin with its reversed host; intervals nest or are apart. Rule
    openings and pages are sorted by key together. At a page, the stack of the last rule opened before it holds every
    rule that can still be open; those whose interval has ended or whose path does not begin the page's are left out,
    and the longest of the rest wins (of equal ones the longer host, then block before allow). The sweep runs per
    range of keys; equal keys are spread by page_id, and each range takes over the last stack of the ranges before it.

    Null URLs and URLs without ``://`` have empty host and path, which no rule fits. Repeated rows come back each. An
    empty table gives no rows, an empty rule table the default for all. Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    stacks = _stacks(rules)
    kind = stacks.schema["stack"].dataType
    events = urls.select("key", F.lit(1).alias("turn"), F.xxhash64("page_id").alias("salt"), "page_id", "host", "path", F.lit(None).cast(kind).alias("stack"))
    events = events.unionByName(stacks.select("key", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("salt"), "stack"), allowMissingColumns=True)
    ranges = tasks(spark)
    swept = stored(events.repartitionByRange(ranges, "key", "turn", "salt").withColumn("part", F.spark_partition_id()), "url-events")

    # one row per range of keys: the stack that the ranges before it leave open
    last = swept.where("turn = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spark.range(ranges).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
    carried = carried.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    at_page = swept.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1").join(carried, "part", "left")
    fits = F.filter(F.coalesce("open", "carried"), lambda e: F.startswith(F.col("key"), e["key"]) & F.startswith(F.col("path"), e["path"]))
    return at_page.withColumn("best", F.array_max(fits)).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
