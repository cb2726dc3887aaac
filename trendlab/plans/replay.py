"""Whether two computations of result tables agree, without bringing their rows together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUM = "decimal(28,0)"  # 64-bit hashes of up to 10**18 rows stay exact


def _plain(field: T.StructField) -> Column:
    """A value as it is hashed: both zeros alike, maps as their ordered entries."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0).cast(field.dataType)
    return F.array_sort(F.map_entries(value)) if isinstance(field.dataType, T.MapType) else value


def table_digest(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_rows, digest)``: equal multisets of rows have equal digests, in whatever order and partitions they come.

    Two independent 64-bit hashes of each row are summed as exact decimals, so rows that occur twice count twice and the partial sums of
    tasks can be merged: only one row per group and task is shuffled. Nulls differ from every value; columns are
    taken by name. An empty table has a digest without ``by`` and no row with it.
    """
    fields = sorted(table.schema.fields, key=lambda f: f.name)
    parts = [p for f in fields for p in (F.col(f"`{f.name}`").isNull(), _plain(f))]
    hashes = [F.xxhash64(F.lit(salt), *parts) for salt in (1, 2)]
    total = lambda c: F.coalesce(F.sum(F.col(c).cast(_SUM)), F.lit(0)).cast("string")
    rows = table.select(*by, *[h.alias(f"_h{i}") for i, h in enumerate(hashes)])
    count = F.count(F.lit(1))
    found = F.sha2(F.concat_ws(":", F.lit(",".join(f.name for f in fields)), count.cast("string"), total("_h0"), total("_h1")), 256)
    return rows.groupBy(*by).agg(count.alias("n_rows"), found.alias("digest"))


def digests(tables: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """``(artefact, *by, n_rows, digest)`` of several tables."""
    each = (table_digest(table, by).select(F.lit(name).alias("artefact"), *by, "n_rows", "digest") for name, table in tables.items())
    return reduce(DataFrame.unionByName, each)


def changed_tables(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame]) -> list[str]:
    """Names of the tables whose digests differ: a number of rows as large as the number of tables reaches the driver."""
    seen = [{r["artefact"]: r["digest"] for r in digests(side).collect()} for side in (first, {n: second[n].select(t.columns) for n, t in first.items()})]
    return [name for name in first if seen[0][name] != seen[1][name]]
