"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlab.llm.common import slices, small_batches

#: Words that make a window; a shorter item is one window of its own.
WINDOW = 10
#: Words of benchmark items that one automaton holds; a larger benchmark is worked off in blocks of this size.
BLOCK_WORDS = 1 << 19
#: Share of hit words over which a text goes as a whole; below it, only its hit words go.
MAX_COVERAGE = 0.5


def _word_bytes() -> bytes:
    """A byte table: ASCII letters become lower case, digits and bytes over 127 stay, all else becomes a space."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


NORMAL = _word_bytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


@dataclass
class Automaton:
    """The suffix automaton of several word sequences: a state stands for the substrings that end at the same places."""

    window: int = WINDOW
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: state -> items with the window that the state stands for; short: state -> (words, items) of whole short items
    items: dict[int, set[int]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, set[int]]]] = field(default_factory=dict)
    #: fewest words of a window
    least: int = WINDOW

    @classmethod
    def of(cls, sequences: list[tuple[int, list[bytes]]], window: int = WINDOW) -> Automaton:
        made = cls(window=window, least=window)
        coded = [(item, [made.vocabulary.setdefault(w, len(made.vocabulary)) for w in words]) for item, words in sequences if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = made._extend(last, code)
        whole: dict[int, dict[int, set[int]]] = {}
        for item, codes in coded:
            made.least = min(made.least, len(codes))
            for state, length in made.walk(codes):
                if length >= window:
                    made.items.setdefault(made._shortened(state, window), set()).add(item)
            if len(codes) < window:
                whole.setdefault(state, {}).setdefault(len(codes), set()).add(item)
        made._spread(whole)
        return made

    def _extend(self, last: int, code: int) -> int:
        """Append a word to the sequence that ends in ``last``; reuses what earlier sequences have made."""
        known = self.step[last].get(code)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        if known is not None:
            return self._split(last, code, known)
        new = self._state(self.size[last] + 1, {})
        at = last
        while at >= 0 and code not in self.step[at]:
            self.step[at][code] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.step[at][code]
            self.link[new] = known if self.size[known] == self.size[at] + 1 else self._split(at, code, known)
        return new

    def _state(self, size: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _split(self, at: int, code: int, known: int) -> int:
        """The part of ``known`` that is one word longer than ``at`` becomes a state."""
        part = self._state(self.size[at] + 1, dict(self.step[known]))
        self.link[part], self.link[known] = self.link[known], part
        while at >= 0 and self.step[at].get(code) == known:
            self.step[at][code] = part
            at = self.link[at]
        return part

    def _shortened(self, state: int, length: int) -> int:
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _spread(self, whole: dict[int, dict[int, set[int]]]) -> None:
        """Every state gets the short items that end wherever it ends: its own and those of the states it links to."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            found = list(self.short.get(self.link[state], ())) + sorted(whole.get(state, {}).items())
            if found:
                self.short[state] = found

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state of the longest suffix that occurs in an item, and its length."""
        step, link, size, state, length = self.step, self.link, self.size, 0, 0
        for code in codes:
            to = step[state].get(code)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(code)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def search(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (start, end) in order of their ends, and the items with occurring windows. Unknown words are -1.

        Only runs of known words that are long enough for a window are walked.
        """
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in known.reshape(-1, 2)[np.diff(known.reshape(-1, 2), axis=1)[:, 0] >= self.least].tolist():
            for at, (state, length) in enumerate(self.walk(codes[start:end].tolist()), start + 1):
                if length >= self.window:
                    spans.append((at - self.window, at))
                    items |= self.items[self._shortened(state, self.window)]
                for words, found in self.short.get(state, ()):
                    if words <= length:
                        spans.append((at - words, at))
                        items |= found
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """An automaton per block of items, each broadcast once; a block has at most ``block_words`` bytes of two per word.

    The size of the benchmark is summed first; items go to blocks by their hash, and only one block at a time is at
    the driver. An item larger than a block still makes one block.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + held // (2 * block_words)
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        texts = sorted((-1 if r["item_id"] is None else r["item_id"], words_of(r["text"].encode())) for r in rows)
        out.append(spark.sparkContext.broadcast(Automaton.of(texts, window)))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``_hits``: n_words, spans (merged hit word positions [start, end)) and items.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null and empty texts and items have
    no words. Items of equal id count as one; a null item_id counts as -1. Blocks of a large benchmark are searched
    one after another in the same pass. Nothing is shuffled.
    """
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("_hits", T.StructType.fromDDL("n_words long, starts array<long>, ends array<long>, items array<long>"))]
    )
    search = _searcher(docs, benchmark, window, block_words)
    kind = pa.struct(
        [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches):
            rows = [{"n_words": n, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": items} for n, spans, items in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, type=kind)], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)


Found = list[tuple[int, list[tuple[int, int]], list[int]]]


def _searcher(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, Found]]]:
    """A function that gives each batch with the word count, merged hit spans and items of its texts."""
    at = docs.schema.names.index("text")
    blocks = automata(benchmark, window, block_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Found]]:
        for batch in slices(batches):
            found: Found = []
            for value in batch.column(at):
                words = words_of((value.as_py() or "").encode())
                spans: list[tuple[int, int]] = []
                items: set[int] = set()
                for block in blocks:
                    automaton = block.value
                    codes = np.fromiter((automaton.vocabulary.get(w, -1) for w in words), np.int64, len(words))
                    more, ids = automaton.search(codes)
                    spans += more
                    items |= ids
                found.append((len(words), merged(spans), sorted(items)))
            yield batch, found

    return search


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row. An empty table gives no rows."""
    found = hits(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window)
    n_hit = F.aggregate(F.zip_with("_hits.starts", "_hits.ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_join(F.array_sort(F.transform("_hits.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits.starts") > 0).alias("contaminated"),
    )


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``spans`` (positions) and what stands between the words of one span."""
    flags = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The rows of ``docs`` without what they share with the benchmark, all columns kept.

    Hit spans go from the text; a row goes as a whole if more than ``max_coverage`` of its words are hit. Rows without
    hits are returned as they are, null and empty texts too. An ``n_chars`` column is set anew where a text changes.
    Repeated rows come back each; texts of any length are searched whole; an empty table gives no rows.
    """
    search = _searcher(docs, benchmark, window, BLOCK_WORDS)
    names = docs.schema.names
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches):
            keep = [sum(b - a for a, b in spans) <= max_coverage * n for n, spans, _ in found]
            columns = list(batch.columns)
            changed = {k: spans for k, (_, spans, _) in enumerate(found) if spans}
            if changed:
                texts = columns[at].to_pylist()
                for k, spans in changed.items():
                    texts[k] = without_words(texts[k].encode(), spans).decode()
                columns[at] = pa.array(texts, type=columns[at].type)
                if length is not None:
                    sizes = [len(texts[k]) if k in changed else n for k, n in enumerate(columns[length].to_pylist())]
                    columns[length] = pa.array(sizes, type=columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def items_digest(items: set[int]) -> str:
    """The digest that ``report`` gives for a set of items."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
