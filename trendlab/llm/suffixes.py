"""Removal of repeated passages with suffix arrays built by Lyndon grouping.

The rule: a byte goes if a ``MATCH``-byte string that covers it also starts in a document with a smaller id.

1. Documents are dealt to groups by their id. In each window of ``MATCH`` bytes the leftmost smallest hash of its
   ``GRAM``-byte grams is its anchor: equal windows have equal anchors, and neighbouring windows mostly share one.
2. Each group sends the distinct hashes of its anchors, packed by bucket; buckets answer which of them other documents
   have as well.
3. Each group sends, for shared anchors alone, the strings that the windows of one anchor cover: each distinct string
   once, with its smallest document and its places.
4. A bucket merges equal strings of all groups, puts those of anchors with several strings into suffix arrays, and reads
   from the order of their suffixes which windows are equal. The first document of each window decides.
5. The groups get the byte ranges that go and cut them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlab.llm.common import small_batches, utf8

#: Bytes of a string that repeats, and of the grams that anchor it.
MATCH, GRAM = 50, 24
#: Bytes of text that a group of documents has on average (a document is never parted).
GROUP_BYTES = 1 << 22
#: Symbols that one suffix array holds on average; the strings of one anchor stay together.
BLOCK_SYMBOLS = 1 << 17
#: A document without id comes after all others.
LAST = (1 << 63) - 1

_WINDOWS = MATCH - GRAM + 1  # windows that can share an anchor
_ROW = 2 + MATCH + _WINDOWS - 1  # a string as a row: place of its anchor, its length, its bytes filled up with zeros
_CHUNK, _AT = 1 << 17, np.uint64((1 << 20) - 1)
# Odd multipliers of the gram hash, made by a rule: multiples of the golden ratio.
_ODD = [np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64) | 1) for k in (1, 3, 5, 7, 11, 13)]


# ---------------------------------------------------------------- suffix array


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, the first rank of its group and the previous smaller suffix (-1 if none).

    Suffixes start in groups by their first symbol. From the greatest group down, each suffix of a group points to the
    nearest smaller suffix before it; of the suffixes pointed to, those with more pointers are greater, and leave
    their group for one right above it. A group that has been processed is final: its members share their longest
    Lyndon prefix. A group is named by its first rank, so names order groups and are never assigned anew.
    """
    n = len(text)
    size = [0] * (max(text, default=0) + 1)
    for c in text:
        size[c] += 1
    first, total = [0] * len(size), 0
    below, left, members = [0] * (n + 1), [0] * (n + 1), {}  # by end: where the group begins; by beginning: its size
    for c, k in enumerate(size):
        if k:
            first[c], left[total], members[total] = total, k, []
            below[total + k] = total
            total += k
    group = [first[c] for c in text]
    for i, g in enumerate(group):
        members[g].append(i)
    smaller = [-1] * n
    end = n
    while end:
        start = below[end]
        pointers: dict[int, int] = {}
        for s in members.pop(start):
            if group[s] != start:
                continue
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if len(pointers) == 1:
            moves = ((next(iter(pointers)),),)
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for p, k in pointers.items():
                by.setdefault((k, group[p]), []).append(p)
            moves = [by[k] for k in sorted(by, reverse=True)]  # most pointers first: they go to the top of their group
        for ps in moves:
            old = group[ps[0]]
            stay = left[old] - len(ps)
            if stay:
                new = old + stay
                left[old], left[new] = stay, len(ps)
                below[new + len(ps)], below[new] = new, old
                for p in ps:
                    group[p] = new
                members[new] = sorted(ps) if len(ps) > 1 else list(ps)
        end = start
    return group, smaller


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in order. Its last symbol must be smaller than all others and occur once.

    The order within groups needs no comparison: going through the ranks upwards, a suffix at rank r settles the
    suffixes whose Lyndon prefix ends where it begins - the one before it and, from there, the chain of previous
    smaller ones that have no place yet - each at the next free rank of its group.
    """
    group, smaller = lyndon_groups(text)
    n = len(text)
    free, order, placed = list(range(n)), [0] * n, [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        s = order[r] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return order


def first_of_windows(strings: np.ndarray, lengths: np.ndarray, docs: np.ndarray, match: int = MATCH) -> np.ndarray:
    """For each string (a row of bytes) and each of its windows the smallest document that has the window in these
    strings; LAST beyond the last window of a string."""
    n, width = strings.shape
    out = np.full((n, width - match + 1), LAST, np.int64)
    text = np.zeros((n, width + 1), np.int64)
    text[:, :width] = strings.astype(np.int64) + 2
    text[np.arange(width + 1)[None, :] >= lengths[:, None]] = 1  # separators
    used = np.arange(width + 1)[None, :] <= lengths[:, None]
    row, column = np.nonzero(used)
    symbols = [*text[used].tolist(), 0]
    order = np.array(suffix_array(symbols)[1:], np.int64)
    row, column = row[order], column[order]
    window = column + match <= lengths[row]
    row, column = row[window], column[window]
    if not len(row):
        return out
    bytes_of = strings[row[:, None], column[:, None] + np.arange(match)]
    new = np.concatenate(([True], (bytes_of[1:] != bytes_of[:-1]).any(axis=1)))
    firsts = np.minimum.reduceat(docs[row], np.flatnonzero(new))
    out[row, column] = firsts[np.cumsum(new) - 1]
    return out


# ---------------------------------------------------------------- anchors


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:n], values[width - size : width - size + n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram, from hashes of doubled lengths: 8 and 16 bytes make 24."""
    at = data.astype(np.uint64) * _ODD[0]
    for k, size in ((1, 1), (2, 2), (3, 4)):
        at = at[:-size] * _ODD[k] + at[size:]
        at ^= at >> np.uint64(29)
    sixteen = at[:-8] * _ODD[4] + at[8:]
    sixteen ^= sixteen >> np.uint64(31)
    whole = (at[: len(at) - 16] * _ODD[5] + sixteen[8:]) * _ODD[0]
    whole ^= whole >> np.uint64(32)
    return whole * _ODD[1]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first and last window start, place of the anchor, its hash."""
    found = []
    for c in range(0, len(data) - MATCH + 1, _CHUNK):
        part = data[c : c + _CHUNK + MATCH - 1]
        hashes = gram_hashes(part)
        at = (_slide(hashes & ~_AT | np.arange(len(hashes), dtype=np.uint64), _WINDOWS) & _AT).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        found.append((first + c, last + c, at[first] + c, hashes[at[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    first, last, anchor, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(offsets, anchor, side="right") - 1
    first, last = np.maximum(first, offsets[row]), np.minimum(last, offsets[row + 1] - MATCH)
    inside = first <= last
    return row[inside], first[inside], last[inside], anchor[inside], hashes[inside]


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 further bits of each hash in one number."""
    return (hashes & np.uint64(0xFFFFFF)) % np.uint64(buckets) << np.uint64(40) | hashes >> np.uint64(24)


def _pack(numbers: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a group in an order that a second reading gives again (equal rows are alike)."""
    keyed = table.select(["_id", "text"])
    return table.take(pc.sort_indices(keyed, sort_keys=[("_id", "ascending"), ("text", "ascending")])).combine_chunks()


def _bytes_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(rows["text"].combine_chunks())
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- steps on groups and buckets


def _send_hashes(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Step 2, group: distinct keys of anchors by bucket; those of several documents of the group twice."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = _ordered(table)
        data, offsets = _bytes_of(rows)
        row, _, _, _, hashes = runs(data, offsets)
        ids = rows["_id"].to_numpy()[row]
        keys = _keys(hashes, buckets)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(keys) else starts
        keys = np.repeat(keys[starts], 1 + several.astype(np.int64))
        return _by_bucket(key[0].as_py(), keys, lambda a, b: _pack(keys[a:b]))

    return run


def _by_bucket(group: int, keys: np.ndarray, payload: Callable[[int, int], bytes]) -> pa.Table:
    """A row per bucket for sorted ``keys``: bucket, group, payload."""
    of = (keys >> np.uint64(40)).astype(np.int32)
    cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table(
        {
            "bucket": pa.array([int(of[a]) for a, _ in pairs], pa.int32()),
            "group": pa.array([group] * len(pairs), pa.int32()),
            "payload": pa.array([payload(a, b) for a, b in pairs], pa.binary()),
        }
    )


def _answer_shared(table: pa.Table) -> pa.Table:
    """Step 2, bucket: to each group those of its keys that several documents have."""
    sent = [_unpack(p) for p in table["payload"].to_pylist()]
    keys, of = np.concatenate(sent), np.repeat(np.arange(len(sent)), [len(s) for s in sent])
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    equal = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
    several = equal[:-1] | equal[1:]
    keys, of = keys[several], of[several]
    order = np.argsort(of, kind="stable")
    keys, of = keys[order], of[order]
    bucket, groups, payloads = table["bucket"][0].as_py(), [], []
    cuts = np.searchsorted(of, np.arange(len(sent) + 1))
    for group, a, b in zip(table["group"].to_pylist(), cuts[:-1], cuts[1:], strict=True):
        if b > a:
            groups.append(group)
            payloads.append(_pack(keys[a:b]))
    return pa.table(
        {"bucket": pa.array([bucket] * len(groups), pa.int32()), "group": pa.array(groups, pa.int32()), "payload": pa.array(payloads, pa.binary())}
    )


def _send_strings(buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Step 3: the distinct strings of shared anchors by bucket, each with its smallest document and its places."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _ordered(table)
        data, offsets = _bytes_of(rows)
        shared = [_unpack(p) | np.uint64(b << 40) for b, p in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True)]
        row, first, last, anchor, hashes = runs(data, offsets)
        keys = _keys(hashes, buckets)
        kept = np.isin(keys, np.concatenate(shared) if shared else np.zeros(0, np.uint64))
        row, first, last, anchor, keys = row[kept], first[kept], last[kept], anchor[kept], keys[kept]
        lines = np.zeros((len(row), _ROW), np.uint8)
        lines[:, 0], lines[:, 1] = anchor - first, last - first + MATCH
        places = np.minimum(first[:, None] + np.arange(_ROW - 2), max(len(data) - 1, 0))
        lines[:, 2:] = np.where(np.arange(_ROW - 2) < lines[:, 1:2], data[places], 0)
        # by key, then string, then document; rows are in order of documents
        order = np.lexsort((row, lines.view(f"V{_ROW}").ravel().argsort(kind="stable").argsort(), keys)) if len(row) else np.zeros(0, np.int64)
        lines, row, keys, first = lines[order], row[order], keys[order], first[order]
        same = np.concatenate((np.zeros(min(1, len(row)), bool), (lines[1:] == lines[:-1]).all(axis=1) & (keys[1:] == keys[:-1])))
        starts = np.flatnonzero(~same)
        ids = rows["_id"].to_numpy()
        smallest = np.minimum.reduceat(ids[row], starts) if len(row) else ids[:0]
        counts = np.diff(np.append(starts, len(row)))
        is_first = (ids[row] == np.repeat(smallest, counts)).astype(np.uint32) << np.uint32(31)
        where = np.column_stack((row.astype(np.uint32) | is_first, (first - offsets[row]).astype(np.uint32))).astype("<u4")

        def payload(a: int, b: int) -> bytes:
            lo, hi = starts[a], starts[b] if b < len(starts) else len(row)
            raw = b"".join((lines[starts[a:b]].tobytes(), smallest[a:b].astype("<i8").tobytes(), counts[a:b].astype("<u4").tobytes(), where[lo:hi].tobytes()))
            return struct.pack("<III", b - a, hi - lo, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)

        return _by_bucket(key[0].as_py(), keys[starts], payload)

    return run


def _read_strings(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, places, size = struct.unpack("<III", payload[:12])
    raw = pa.decompress(payload[12:], decompressed_size=size, codec="zstd", asbytes=True)
    cuts = np.cumsum([n * _ROW, 8 * n, 4 * n])
    return (
        np.frombuffer(raw[: cuts[0]], np.uint8).reshape(n, _ROW),
        np.frombuffer(raw[cuts[0] : cuts[1]], "<i8"),
        np.frombuffer(raw[cuts[1] : cuts[2]], "<u4").astype(np.int64),
        np.frombuffer(raw[cuts[2] :], "<u4").reshape(places, 2),
    )


def _answer_ranges(table: pa.Table) -> pa.Table:
    """Step 4: to each group the byte ranges (row, start, end) that go."""
    sent = [_read_strings(p) for p in table["payload"].to_pylist()]
    lines, docs = np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent])
    distinct, of = np.unique(lines.view(f"V{_ROW}").ravel(), return_inverse=True)
    strings = distinct.view(np.uint8).reshape(-1, _ROW)
    first = np.full(len(strings), LAST, np.int64)
    np.minimum.at(first, of, docs)
    windows = _first_documents(strings, first)
    out = {"group": [], "payload": []}
    at = 0
    for group, (own, smallest, counts, places) in zip(table["group"].to_pylist(), sent, strict=True):
        n = len(own)
        goes = windows[of[at : at + n]] < smallest[:, None]  # for the smallest document that has the string here
        at += n
        whole = np.arange(windows.shape[1]) <= (own[:, 1].astype(np.int64) - MATCH)[:, None]
        entry = np.repeat(np.arange(n), counts)
        is_first = places[:, 0] >> 31 == 1
        mask = np.where(is_first[:, None], goes[entry], whole[entry])
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (rows, starts), (_, ends) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        if len(rows):
            base = places[rows, 1].astype(np.int64)
            ranges = np.column_stack((places[rows, 0] & 0x7FFFFFFF, base + starts, base + ends - 1 + MATCH)).astype("<u4")
            out["group"].append(group)
            out["payload"].append(struct.pack("<I", ranges.nbytes) + pa.compress(ranges.T.tobytes(), codec="zstd", asbytes=True))
    return pa.table({"group": pa.array(out["group"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})


def _first_documents(strings: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each string and window the smallest document that has the window. ``strings``: distinct rows."""
    lengths = strings[:, 1].astype(np.int64)
    out = np.where(np.arange(_WINDOWS) <= (lengths - MATCH)[:, None], first[:, None], LAST)
    grams = strings[np.arange(len(strings))[:, None], 2 + strings[:, :1].astype(np.int64) + np.arange(GRAM)]
    _, anchor, times = np.unique(np.ascontiguousarray(grams).view(f"V{GRAM}").ravel(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[anchor] > 1)
    several = several[_may_share(strings[several])]
    several = several[np.argsort(anchor[several], kind="stable")]
    ends = np.flatnonzero(np.append(anchor[several][1:] != anchor[several][:-1], True)) + 1 if len(several) else several
    start, total = 0, np.concatenate(([0], np.cumsum(lengths[several] + 1)))
    for k, end in enumerate(ends):
        if total[end] - total[start] >= BLOCK_SYMBOLS or k == len(ends) - 1:
            block = several[start:end]
            out[block] = first_of_windows(strings[block, 2:], lengths[block], first[block])
            start = end
    return out


def _may_share(strings: np.ndarray) -> np.ndarray:
    """Whether another of the distinct strings has the anchor with the ``side`` bytes before it, or with those after it.

    Each window holds the bytes of one side, so the others share no window with any string.
    """
    side, out = (MATCH - GRAM) // 2, np.zeros(len(strings), bool)
    at, length = strings[:, 0].astype(np.int64), strings[:, 1].astype(np.int64)
    for start, fits in ((at - side, at >= side), (at, at + GRAM + side <= length)):
        own = np.flatnonzero(fits)
        wide = np.ascontiguousarray(strings[own[:, None], 2 + start[own, None] + np.arange(GRAM + side)])
        _, of, times = np.unique(wide.view(f"V{GRAM + side}").ravel(), return_inverse=True, return_counts=True)
        out[own] |= times[of] > 1
    return out


def _ranges(answers: pa.Table) -> np.ndarray:
    """All ranges of a group, by row and start."""
    parts = [np.zeros((0, 3), np.int64)]
    for p in answers["payload"].to_pylist():
        raw = pa.decompress(p[4:], decompressed_size=struct.unpack("<I", p[:4])[0], codec="zstd", asbytes=True)
        parts.append(np.frombuffer(raw, "<u4").reshape(3, -1).T.astype(np.int64))
    ranges = np.concatenate(parts)
    return ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]


def _merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in ranges.tolist():
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text when the byte ranges ``spans`` go."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


# ---------------------------------------------------------------- the operator


def _with_spans(docs: DataFrame, finish: Callable[[pa.Table, list[bytes], list[list[tuple[int, int]]]], pa.Table], schema: T.StructType, group_bytes: int) -> DataFrame:
    """``finish`` gets the rows of a group, their texts as UTF-8 and the byte ranges that go from each."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = int(1 + held // group_bytes)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # one exchange of the texts, which the plan reads three times
    dealt = small_batches(docs).select(F.pmod(F.xxhash64(order), F.lit(groups)).cast("int").alias("_group"), order.alias("_id"), *docs.columns)
    by_group = dealt.groupBy("_group")
    packed = "bucket int, group int, payload binary"
    sent = by_group.applyInArrow(_send_hashes(groups), packed)
    shared = sent.groupBy("bucket").applyInArrow(_answer_shared, packed)
    strings = by_group.cogroup(shared.groupBy("group")).applyInArrow(_send_strings(groups), packed)
    ranges = strings.groupBy("bucket").applyInArrow(_answer_ranges, "group int, payload binary")

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _ordered(table)
        found = _ranges(answers)
        cuts = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
        spans = [_merged(found[a:b, 1:]) if b > a else [] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        texts = [(t or "").encode() for t in rows["text"].to_pylist()]
        return finish(rows.drop_columns(["_group", "_id"]), texts, spans)

    return by_group.cogroup(ranges.groupBy("group")).applyInArrow(cut, schema)


def removals(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go) of every row.

    Null text is empty. Rows of one doc_id are one document to the rule (none of them is smaller); a null doc_id comes
    after all others. Texts under 50 bytes stay whole. An empty table gives no rows; other columns are not read.
    """

    def finish(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return _with_spans(rows, finish, T.StructType.fromDDL(schema), group_bytes)


def without_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, all columns kept; bytes of a character that was cut go too.

    A row from which all goes stays, with an empty text. An ``n_chars`` column is set anew where a text changes. A null text
    stays null, repeated rows come back each, rows without doc_id come after all others; an empty table gives no rows. Other
    columns may have any names.
    """
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"column{k}" for k, c in enumerate(names)])

    def finish(rows: pa.Table, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        old = rows["text"].to_pylist()
        left = [kept_bytes(t, s).decode(errors="ignore") if s else o for o, t, s in zip(old, texts, spans, strict=True)]
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(left, pa.string()))
        if (at := rows.schema.get_field_index("n_chars")) >= 0:
            sizes = [len(t) if s else n for t, s, n in zip(left, spans, rows["n_chars"].to_pylist(), strict=True)]
            rows = rows.set_column(at, "n_chars", pa.array(sizes, rows.schema.field(at).type))
        return rows

    return _with_spans(docs, finish, docs.schema, group_bytes).toDF(*names)
