"""Near-duplicates by SimHash and meet-in-the-middle ball hashing; near copies by the same balls, MinHash beyond their reach, exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trendlab.llm.common import fresh, per_text, small_batches, tasks
from trendlab.sources.sinks import stored

#: Words per shingle, seed of their hash, differing bits that still link two fingerprints.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Near copies: words per shingle, tenths of the shingles of both texts that they share at least (Jaccard).
COPY_SHINGLE, COPY_TENTHS = 5, 8
#: MinHash bands of a text and minima in each: at a similarity of 0.8 all bands of two texts differ with 3 in a million.
BANDS, MINIMA = 24, 4
#: Keys that come before the MinHash bands: equal halves of fingerprints, and balls around halves.
EQUAL, BALL = -2, -1
#: First bands of the batches that are tried one after the other; sets of a key that are tried together.
BATCHES, BLOCK = (EQUAL, BALL, 0, 1, 3, 8), 256
#: Shingles whose columns are multiplied at a time.
_COLUMNS = 1 << 12
#: Shingles of a text that are hashed at a time.
_CHUNK = 1 << 16
# Odd multipliers and masks of the MinHash orders, made by a rule: hashes of their numbers.
_ORDERS = np.array([xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(2 * BANDS * MINIMA)], np.uint64).reshape(2, -1)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if over half of the shingle hashes set it; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        part = words[start : start + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        ones += _bit_counts(np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.dtype(">u8")))
    return _majority(ones, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (long) of every row. Null and empty texts have fingerprint 0."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(per_text(lambda text: (fingerprint(text, shingle, seed),), out), "doc_id long, fp long")


def _balls(values: DataFrame, bits: int = 64) -> DataFrame:
    """centre and members of every ball that holds two of the distinct ``values`` (fp) or more: those within one of its ``bits`` lowest bits.

    A ball meets at most its own neighbours, kept as a bit mask of a row, so its size is bounded.
    """
    shifts = F.array(*[F.lit(k) for k in range(-1, bits)])
    near = values.select("fp", F.explode(shifts).alias("bit"))
    flip = F.when(F.col("bit") < 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, bit)"))
    balls = (
        near.select(F.col("fp").bitwiseXOR(flip).alias("centre"), flip.alias("flip"), (F.col("bit") < 0).cast("int").alias("own"))
        .groupBy("centre")
        .agg(F.bit_or("flip").alias("mask"), F.max("own").alias("own"))
        .where(F.bit_count("mask") + F.col("own") > 1)
    )
    flipped = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    return balls.select(
        "centre",
        F.concat(
            F.transform(flipped, lambda k: F.col("centre").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))),
            F.when(F.col("own") == 1, F.array("centre")).otherwise(F.array().cast("array<long>")),
        ).alias("members"),
    )


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a < b) that connect distinct fingerprints at 2 or fewer differing bits.

    Every fingerprint emits the 65 values within one bit of it, half the radius: two fingerprints meet in such a value
    exactly if they differ in at most 2 bits. A value meets at most its own 65 neighbours, kept as a bit mask of a row,
    so a group of any number of copies stays two numbers. The members of a mask are chained to its smallest one, not
    paired with each other, and each link is verified.
    """
    members = _balls(prints.select("fp").distinct())
    links = members.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches; two alternating star contractions.

    Each round is written to the shared folder; nodes and links never pass through the driver, only their count and
    checksum. The rounds grow with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row.

    Texts without words have fingerprint zero and link like any other. Null doc_ids sort last: such a row's component
    is the smallest doc_id it reaches, or null. Repeated rows come back each. An empty table gives no rows. Other
    columns are not read.
    """
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")
    roots = components(ball_links(prints))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = stored(
        firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots"
    )
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int = COPY_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if len(words) < shingle:
        words, shingle = [b" ".join(words)] if words else [], 1
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed key per band: the hash of its minima. Two texts agree in a band with their similarity to the power of MINIMA."""
    if not len(shingles):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1 << 10):
        part = (shingles[start : start + (1 << 10), None] ^ _ORDERS[0]) * (_ORDERS[1] | np.uint64(1))
        np.minimum(least, part.min(axis=0), out=least)
    keys = [xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def half_prints(shingles: np.ndarray) -> list[int]:
    """The two halves of the fingerprint of a shingle set, told apart by bit 32. Within 5 bits of 64, one half is within 2."""
    if not len(shingles):
        return []
    ones = sum((_bit_counts(shingles[start : start + _CHUNK]) for start in range(0, len(shingles), _CHUNK)), np.zeros(64, np.int64))
    whole = _majority(ones, len(shingles))
    return [whole & 0xFFFFFFFF, (whole >> 32 & 0xFFFFFFFF) | 1 << 32]


def _copy_prints(text: bytes) -> tuple[int, list[int], list[int]]:
    shingles = shingle_set(text)
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)), half_prints(shingles), band_keys(shingles)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: products of 0-1 columns, some thousand shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1  # a shingle of one set is shared with none
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.concatenate(([0], np.diff(column[order]) != 0)))[: len(order)]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, (start, start + _COLUMNS))
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[low:high], column[low:high] - start] = 1
        shared += held @ held.T
    return shared.astype(np.int64)


def _forest(prints: list[int], labels: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of similar sets that join different labels, as few as join them all."""
    sizes = np.array([len(x) for x in sets])
    shared = _overlaps(sets)
    left, right = np.nonzero(np.triu(10 * shared >= COPY_TENTHS * (sizes[:, None] + sizes - shared), 1))
    root = {label: label for label in labels}

    def of(label: int) -> int:
        while root[label] != label:
            root[label] = label = root[root[label]]
        return label

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        one, two = of(labels[i]), of(labels[j])
        if one != two:
            root[one] = two
            yield min(prints[i], prints[j]), max(prints[i], prints[j])


def _tried(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) found in each trial: ``rows`` (key, p, q, fp, label) with one key, p and q are tried with each other.

    A trial is as large as a block or two. Sets come to the rows by a join and stream through the task trial by trial; only
    links leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        found: list[tuple[int, int]] = []

        def finish() -> None:
            unlike = {fp: (label, shingles) for fp, label, shingles in held}
            if len({label for label, _ in unlike.values()}) > 1:
                found.extend(_forest(list(unlike), [label for label, _ in unlike.values()], [np.frombuffer(x, np.uint64) for _, x in unlike.values()]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for key, p, q, fp, label, shingles in zip(*columns, strict=True):
                if (key, p, q) != at:
                    finish()
                    at, held = (key, p, q), []
                held.append((fp, label, shingles))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found.clear()
        finish()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    dealt = rows.join(sets, "fp").select("key", "p", "q", "fp", "label", "shingles").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return small_batches(dealt).mapInArrow(run, "a long, b long")


def _in_balls(halves: DataFrame) -> DataFrame:
    """fp and key (below zero) of the sets in every ball of radius 1 around halves of fingerprints that holds several; ``halves``: fp, key."""
    values = halves.select(F.col("key").alias("fp")).repartition(tasks(halves.sparkSession), "fp").distinct()
    members = _balls(values, 32).select((-1 - F.col("centre")).alias("ball"), F.explode("members").alias("key"))
    return halves.join(members, "key").select("fp", F.col("ball").alias("key"))


def _shared_bands(prints: DataFrame) -> DataFrame:
    """fp, key, band, block, blocks of every distinct shingle set in the keys that it has in common with another one.

    The keys are equal halves of fingerprints, balls around halves, and MinHash bands. The sets of a key are dealt to blocks
    of about ``BLOCK`` by a hash that differs from band to band.
    """
    sets = prints.groupBy("fp").agg(F.first("halves").alias("halves"), F.first("keys").alias("keys"))
    halves = stored(sets.select("fp", F.explode("halves").alias("key")), "halves")
    balls = stored(_in_balls(halves), "in-balls")
    held = (
        sets.select("fp", F.posexplode("keys").alias("band", "key"))
        .unionByName(halves.withColumn("band", F.lit(EQUAL)))
        .unionByName(balls.withColumn("band", F.lit(BALL)))
    )
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    return held.join(sizes, "key").select("fp", "key", "band", F.pmod(F.xxhash64("fp", "key"), "blocks").cast("int").alias("block"), "blocks")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of keys in which two labels or more are left."""
    labelled = members.join(labels, "fp")
    several = labelled.groupBy("key").agg((F.min("label") < F.max("label")).alias("several")).where("several").select("key")
    return labelled.join(several, "key", "left_semi")


def _across_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Trials (key, p, q, fp, label) between the blocks of a key: each set outside its key's most frequent label meets every block.

    Those sets, in blocks p of their own, go to each block q, and the sets of block q to each p.
    """
    large = _open(members.where("blocks > 1"), labels)
    counted = large.groupBy("key", "label").agg(F.count("*").alias("size"))
    major = counted.groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("major"), F.sum("size").alias("all"), F.max("size").alias("most"))
    major = major.select("key", "major", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("parts"))
    sided = large.join(major, "key")
    minor = sided.where("label <> major").withColumn("p", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    minor = minor.select("key", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), "fp", "label")
    every = sided.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("block").alias("q"), "fp", "label")
    return minor.unionByName(every)


def _relabelled(labels: DataFrame, similar: DataFrame) -> DataFrame:
    """Labels after two steps along ``similar`` links to smaller ones: sets of one label are linked, directly or over others."""
    of = lambda x: labels.select(F.col("fp").alias(x), F.col("label").alias(f"label_{x}"))
    ends = similar.join(of("a"), "a").join(of("b"), "b").select("label_a", "label_b").distinct()
    both = ends.unionByName(ends.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b")))
    step = both.groupBy(F.col("label_a").alias("label")).agg(F.least(F.first("label_a"), F.min("label_b")).alias("to"))
    twice = step.join(step.select(F.col("label").alias("to"), F.col("to").alias("then")), "to", "left").select("label", F.coalesce("then", "to").alias("to"))
    return labels.join(twice, "label", "left").select("fp", F.coalesce("to", "label").alias("label"))


def copy_links(texts: DataFrame, prints: DataFrame, row: str) -> DataFrame:
    """Links (a, b) that join all shingle sets which share 0.8 of their shingles. ``texts``: row and text; ``prints``: row, fp, halves, keys.

    Sets whose fingerprints have a half within 2 bits of each other, which meet in a ball, are candidates first: all within 5 of the
    64 bits, and more. Texts that share 0.8 may be 20 bits apart, beyond what balls reach, so sets with a MinHash band in common are
    candidates next. The sets of a ball or band key are tried with each other in blocks, counted exactly
    inside a task, which gives back only the links that join what was not joined before. Keys are taken in batches; a key whose
    sets all have one label by then, so are linked already, is left out. At the end the blocks of large keys meet: what
    is still outside a key's most frequent label is tried with all of its blocks. So every candidate pair is counted
    unless its two sets are known to be in one group.
    """
    members = stored(_shared_bands(prints), "shared-bands")
    chosen = members.select("fp").distinct()
    rows = stored(prints.groupBy("fp").agg(F.min(row).alias(row)).join(chosen, "fp").select(row, "fp"), "tried-rows")
    out = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])
    read = texts.join(rows, row).select("fp", "text")
    sets = stored(small_batches(read).mapInArrow(per_text(lambda text: (shingle_set(text).tobytes(),), out), "fp long, shingles binary"), "sets")
    labels, found = rows.select("fp", F.col("fp").alias("label")), []
    for first, end in zip((*BATCHES, None), (*BATCHES[1:], BANDS, None), strict=True):
        if first is None:
            trials = _across_blocks(members, labels)
        else:
            trials = _open(members.where(F.col("band").between(first, end - 1)), labels).select("key", F.col("block").alias("p"), F.lit(0).alias("q"), "fp", "label")
        links = stored(_tried(trials, sets), "copy-links")
        found.append(links)
        if first is not None:
            labels = stored(_relabelled(labels, links), "labels")
    return reduce(DataFrame.unionByName, found)


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the first by doc_id (nulls last), then by place; all columns kept.

    Near copies share 0.8 or more of their 5-word shingles (Jaccard, A-Z lower-cased); groups are closed over such links.
    Texts without words are copies of each other. ``docs`` is read several times and must return its rows in one order,
    as a table does; write the result of a shuffle first. Long texts are read whole, an empty table gives no rows.
    """
    row = fresh(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    texts = placed.select(row, F.col("text").cast("string").alias("text"))
    out = pa.schema([(row, pa.int64()), ("fp", pa.int64()), ("halves", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
    made = small_batches(texts).mapInArrow(per_text(_copy_prints, out), f"`{row}` long, fp long, halves array<long>, keys array<long>")
    prints = stored(made, "copy-prints")
    roots = components(copy_links(texts, prints, row))
    ids = placed.select(row, F.col("doc_id").cast("long").alias("doc_id"))
    grouped = stored(
        prints.select(row, "fp").join(ids, row).join(roots, F.col("fp") == F.col("node"), "left").select(row, "doc_id", F.coalesce("root", "fp").alias("root")),
        "copy-groups",
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("at"))
    kept = grouped.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.at").alias(row))
    return placed.join(kept, row, "left_semi").drop(row)
