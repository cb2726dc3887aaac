"""Runs of periodic words: recursive frequency splitting leaves few segments, which a lag scan decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import slices, small_batches

#: A run has at least so many words, and at least two periods.
MIN_WORDS = 12
#: Lags up to this one are compared at every word; beyond, at every lag-th word, confirmed by windows of half as many words.
DENSE_LAG = 64
_WINDOW = DENSE_LAG // 2
#: Bulk splitting goes on while a round removes at least one word in so many; what is left is split segment by segment.
_SLOW = 32


def _segments(pos: np.ndarray) -> np.ndarray:
    """The number of the segment of each position: a stretch of consecutive ones."""
    return np.cumsum(np.concatenate(([0], np.diff(pos) != 1)))


def _split_one(words: list[int], offset: int, least: int) -> Iterator[tuple[int, int]]:
    """Stable parts (start, end) of one segment. Counts of the largest part are what the smaller ones leave of the whole's."""
    todo = [(0, len(words), Counter(words))]
    while todo:
        a, b, times = todo.pop()
        if b - a < least:
            continue
        if min(times.values()) > 1:
            yield offset + a, offset + b
            continue
        cuts = [a - 1, *(k for k in range(a, b) if times[words[k]] == 1), b]
        parts = sorted(((e - s - 1, s + 1, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)), reverse=True)
        for _, s, e in parts[1:]:
            part = Counter(words[s:e])
            times.subtract(part)
            todo.append((s, e, part))
        _, s, e = parts[0]
        for k in cuts[1:-1]:
            del times[words[k]]
        todo.append((s, e, +times))


def split(words: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Segments (start, end) of ``words`` in which every word occurs twice or more, found by recursive splitting.

    Negative words separate. A word that a run of at least two periods holds occurs in it at least twice; a word that
    occurs once in a segment is in no run inside it, and no run crosses it, so it splits the segment. The parts are
    counted anew until nothing changes. All segments of a round are counted together; segments that are stable, or
    shorter than ``least``, leave.
    """
    pos, done, base = np.flatnonzero(words >= 0), [], int(words.max(initial=0)) + 1
    slow = False
    while len(pos) and not slow:
        seg = _segments(pos)
        long = np.bincount(seg)[seg] >= least
        pos, seg = pos[long], seg[long]
        if not len(pos):
            break
        _, inverse, times = np.unique(seg * base + words[pos], return_inverse=True, return_counts=True)
        lonely = times[inverse] == 1
        stable = np.bincount(seg, lonely)[seg] == 0
        done.append(pos[stable])
        kept = pos[~stable & ~lonely]
        slow = _SLOW * int(lonely.sum()) < len(pos) - len(done[-1])
        pos = kept
    found: list[tuple[int, int]] = []
    for group, settled in ((np.concatenate(done) if done else pos[:0], True), (pos, False)):
        group = np.sort(group)
        if not len(group):
            continue
        breaks = np.flatnonzero(np.diff(group) != 1)
        starts, ends = group[np.concatenate(([0], breaks + 1))], group[np.concatenate((breaks, [len(group) - 1]))] + 1
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if settled:
                found.append((a, b))
            elif b - a >= least:
                found.extend(_split_one(words[a:b].tolist(), a, least))
    return sorted(found)


def _window_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the ``_WINDOW`` words from each position on: equal windows have equal hashes. Made by doubling."""
    h, size = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03), 1
    while size < _WINDOW:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[size:] * np.uint64(0x94D049BB133111EB)
        size *= 2
    return h


def _reach(x: np.ndarray, j: int, lag: int, step: int) -> int:
    """How many positions from ``j`` on, in direction ``step``, equal the one ``lag`` further; in growing chunks."""
    limit = len(x) - lag - j if step > 0 else j + 1
    n, size = 0, 256
    while n < limit:
        size = min(2 * size, limit - n)
        a = x[j + n : j + n + size] if step > 0 else x[j - n - size + 1 : j - n + 1][::-1]
        b = x[j + lag + n : j + lag + n + size] if step > 0 else x[j + lag - n - size + 1 : j + lag - n + 1][::-1]
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return n + int(unlike[0])
        n += size
    return n


def _dense(x: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of period ``lag``: enough consecutive words equal the one a lag further."""
    need, same = max(least - lag, lag), x[lag:] == x[:-lag]
    if int(same.sum()) < need:
        return
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    yield from zip(starts[long].tolist(), (ends[long] + lag).tolist(), strict=True)


def runs(x: np.ndarray, least: int = MIN_WORDS, dense: int = DENSE_LAG) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of ``x`` of at least ``least`` words and two periods; the lag scan.

    Lags ascend. A stretch found before at a smaller lag has that one as its period. Beyond ``dense``, a run of period q
    holds two consecutive multiples of q, since it has 2 q words, and the stretch of equal words around the first one is
    longer than ``dense``, so one of the windows that begin or end there is equal as well; only those places are
    extended. Inside a run whose period divides q nothing new can be found at lag q.
    """
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(dense, len(x) // 2) + 1):
        for span in _dense(x, lag, least):
            found.setdefault(span, lag)
    if len(x) // 2 > dense:
        hashes = _window_hashes(x)
        known = sorted((b - a, a, b, q) for (a, b), q in found.items() if b - a > dense)
        size, start, stop, period = (np.array(c, np.int64) for c in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 4
        for lag in range(dense + 1, len(x) // 2 + 1):
            at = np.arange(0, len(x) - lag, lag)
            at = at[x[at] == x[at + lag]]
            if not len(at):
                continue
            ahead, back = at[at + lag < len(hashes)], at[at >= _WINDOW - 1]
            ahead = ahead[hashes[ahead] == hashes[ahead + lag]]
            back = back[hashes[back - _WINDOW + 1] == hashes[back - _WINDOW + 1 + lag]]
            at = np.union1d(ahead, back)
            if len(at) and len(size):
                over = np.searchsorted(size, lag, side="right")
                fits = lag % period[over:] == 0
                order = np.argsort(start[over:][fits], kind="stable")
                a, b = start[over:][fits][order], stop[over:][fits][order]
                if len(a):  # such runs overlap by less than a lag, so at most one of them holds both places
                    k = np.searchsorted(a, at, side="right") - 1
                    inside = (k >= 0) & (at + lag < b[k])
                    earlier = (k >= 1) & (at + lag < b[np.maximum(k - 1, 0)])
                    at = at[~inside & ~earlier]
            fresh, end = [], -1
            for j in at.tolist():
                if j < end:
                    continue
                s, e = j - _reach(x, j, lag, -1) + 1, j + _reach(x, j, lag, 1)
                end = e
                if e - s >= lag and (s, e + lag) not in found:
                    found[s, e + lag] = lag
                    fresh.append((e + lag - s, s, e + lag, lag))
            if fresh:
                merged = sorted([*zip(size.tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True), *fresh])
                size, start, stop, period = (np.array(c, np.int64) for c in zip(*merged, strict=True))
    return sorted((a, b, q) for (a, b), q in found.items())


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, with a -1 behind each text, and the place where each text begins."""
    ids: dict[bytes, int] = {}
    numbers = np.fromiter(
        chain.from_iterable(chain((ids.setdefault(w, len(ids)) for w in words), (-1,)) for words in texts), np.int64
    )
    begins = np.cumsum([0, *(len(words) + 1 for words in texts)])
    return numbers, begins


def runs_of(texts: list[list[bytes]], least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period. All texts are split together."""
    numbers, begins = _numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    segments = split(numbers, least)
    owner = np.searchsorted(begins, [a for a, _ in segments], side="right") - 1
    for (a, b), k in zip(segments, owner.tolist(), strict=True):
        offset = a - int(begins[k])
        out[k].extend((s + offset, e - s, q) for s, e, q in runs(numbers[a:b], least))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not found:
        return b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist()).decode()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period) and collapsed text of every row.

    A run is a stretch of words with smallest period q, of at least ``least`` words and two periods, that no neighbouring
    word extends. The collapsed text leaves out what a run holds after its first period. Null and empty texts have no
    words, no runs and an empty collapsed text. Texts of any length are treated whole. Repeated rows come back each,
    null ids stay null, an empty table gives no rows, other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t.as_py() or "").encode().split() for t in batch.column(1)]  # bytes: the six ASCII white-space characters
            found = runs_of(texts, least)
            rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in found], _OUT.field(1).type)
            texts_left = pa.array([collapsed(words, of) for words, of in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, texts_left], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(work, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found: Column) -> Column:
    """The longest run of an array of runs (ties: smallest start, then period); null if there is none."""
    order = F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
    first = F.try_element_at(order, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["start"].alias("start"), (-first["neg"]).alias("length"), first["period"].alias("period")))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document by the CRC-32 of its id, made periodic from some word on; other texts as they are.

    With h the CRC-32 of the decimal id, g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)),
    word i >= a becomes word a + (i - a) % p. A text without an id stays as it is.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    code = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(code / 10)

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p, rest = F.lit(1) + F.floor((n - a) / (3 + g % 8)), n - a
        cut = lambda words, start, size: F.slice(words, start.cast("int"), size.cast("int"))
        block = F.array_repeat(cut(w, a + 1, p), F.ceil(rest / p).cast("int"))
        return F.array_join(F.concat(cut(w, F.lit(1), a), cut(F.flatten(block), F.lit(1), rest)), " ")

    # one lambda over a one-element array, so that the words are split once
    whole = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.lit(""))), 0)
    return F.when((code % 10 == 0) & text.isNotNull(), whole).otherwise(text)
