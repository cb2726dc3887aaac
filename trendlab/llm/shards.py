"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.sources.sinks import stored

#: Bits of the hash that may address a shard, and how many of them one round looks at.
HASH_BITS, ROUND_BITS = 60, 12
#: Bytes of text that a shard may hold.
LIMIT_BYTES = 1 << 20


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, round_bits: int = ROUND_BITS, part_ids: bool = False) -> DataFrame:
    """The shard of every row: doc_id, n_bytes, shard (its hash prefix in bits), local_depth, shard_bytes, oversized.

    A bucket is a prefix of the 60-bit hash of doc_id. It splits on its next bit only while it holds more than
    ``limit_bytes``, so neighbours keep different depths. A round sums bytes into the cells ``round_bits`` deeper than
    the open buckets and rolls them up to every depth between; cells that are still too large go on to the next round.

    Rows of one doc_id (or none) share a hash. Unless ``part_ids`` is set they stay together: a bucket with a single hash is not
    split, and is ``oversized`` if it is over the limit. With ``part_ids`` the rows of such a bucket take, behind the bits that lead
    to it, the bits of a hash of their text, and where texts are equal too, of a number of the row. So only a single
    text over the limit is ``oversized``. Which of several equal rows goes where depends on how the table is read.

    Null text has 0 bytes; a null doc_id hashes like an empty string. An empty table gives no rows. Other columns are not read.
    """
    if limit_bytes < 1 or not 1 <= round_bits <= HASH_BITS:
        raise ValueError(f"a shard needs a positive limit and rounds of 1 to {HASH_BITS} bits: {limit_bytes}, {round_bits}")
    bits = lambda name: F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    open_rows = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
            bits(F.xxhash64("text").cast("string")).alias("h_text"),
            bits(F.monotonically_increasing_id().cast("string")).alias("h_row"),
        ),
        "shard-rows",
    )
    placed, depth = [], 0
    while True:
        top, depth = depth, min(depth + round_bits, HASH_BITS)
        rows, going_on = open_rows.withColumn("least", F.lit(top)), []
        for further in (("h_text", "h_row", None) if part_ids else (None,)):
            rows = rows.withColumn("cell", F.shiftright("h", HASH_BITS - depth))
            cells = stored(_leaves(rows, depth, limit_bytes, further is None), "shard-cells")
            placed.append(rows.join(cells.where("local_depth is not null and not alike"), "cell"))
            still_open = cells.where("local_depth is null").select("cell")
            if not still_open.isEmpty():
                going_on.append(rows.join(still_open, "cell", "left_semi").drop("cell"))
            alike = cells.where("alike").select("cell", "local_depth")
            if alike.isEmpty():
                break
            # the bits up to the bucket stay, those behind it are the further hash's
            kept = F.expr(f"shiftleft(shiftright(h, {HASH_BITS} - local_depth), {HASH_BITS} - local_depth)")
            behind = F.expr(f"{further} & (shiftleft(1L, {HASH_BITS} - local_depth) - 1)")
            rows = rows.join(alike, "cell").withColumn("h", kept.bitwiseOR(behind)).drop("cell", "least").withColumnRenamed("local_depth", "least")
        if not going_on:
            break
        open_rows = reduce(DataFrame.unionByName, going_on)
    return reduce(DataFrame.unionByName, placed).select(
        "doc_id",
        "n_bytes",
        F.expr("lpad(bin(prefix), local_depth, '0')").alias("shard"),
        "local_depth",
        "shard_bytes",
        (F.col("shard_bytes") > limit_bytes).alias("oversized"),
    )


def _leaves(rows: DataFrame, depth: int, limit_bytes: int, last: bool) -> DataFrame:
    """For each cell at ``depth``: the shallowest bucket, from the depth ``least`` of its rows on, that need not split, or nulls.

    ``alike`` marks a bucket over the limit that has several rows of one hash, which another hash may part (none is left if ``last``).
    """
    cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"), F.max("least").alias("least"))
    paths = cells.withColumn("d", F.explode(F.sequence("least", F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {depth} - d)")
    )
    buckets = paths.groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes"), (F.min("lo") == F.max("hi")).alias("single"), F.sum("n").alias("n"))
    settled = buckets.where((F.col("shard_bytes") <= limit_bytes) | F.col("single") | (F.col("d") == HASH_BITS))
    settled = settled.withColumn("alike", (F.col("shard_bytes") > limit_bytes) & F.col("single") & (F.col("n") > 1) & (F.col("d") < HASH_BITS) & F.lit(not last))
    found = paths.select("cell", "d", "prefix").join(settled, ["d", "prefix"], "left")
    leaf = found.groupBy("cell").agg(F.min_by(F.struct("d", "prefix", "shard_bytes", "alike"), F.when(F.col("shard_bytes").isNotNull(), F.col("d"))).alias("leaf"))
    return leaf.select(
        "cell", F.col("leaf.d").alias("local_depth"), F.col("leaf.prefix").alias("prefix"), F.col("leaf.shard_bytes").alias("shard_bytes"),
        F.coalesce("leaf.alike", F.lit(False)).alias("alike"),
    )


def directory(placed: DataFrame) -> DataFrame:
    """The directory of a placement: an entry per shard with its depth, size and the entries of the global directory it fills."""
    shards = placed.groupBy("shard", "local_depth", "shard_bytes", "oversized").agg(F.count("*").alias("n_docs"))
    deepest = shards.agg(F.coalesce(F.max("local_depth"), F.lit(0)).alias("global_depth"))
    # one row of bounded size beside the shards
    return shards.join(F.broadcast(deepest)).withColumn("n_entries", F.expr("shiftleft(1L, global_depth - local_depth)"))
