"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import slices, small_batches

#: Words of a window whose repetition counts, and the characters that count as symbols.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Rows whose rule costs and selectivity are measured: those with the smallest hash of doc_id.
SAMPLE_ROWS = 2000
_SPACE = " \t\n\v\f\r"


class Text:
    """A text with measures that are computed when a rule first asks for them."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes: splits at the six ASCII white-space characters only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.text.split("\n") if line.strip(_SPACE)]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        windows = list(zip(*(self.words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times, covered, end = Counter(windows), 0, 0
        for start, window in enumerate(windows):
            if times[window] > 1:
                covered += start + WINDOW - max(start, end)
                end = start + WINDOW
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


#: The base rules of the contract, then those of this library: share of symbols in the text, share of repeated lines and
#: the mean length of a word.
RULES = (
    Rule("few_words", lambda t: t.n_words < 10, base=True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words, base=True),
    Rule("symbols", lambda t: 16 * t.n_symbols > t.word_chars),
    Rule("repeated_lines", lambda t: 3 * t.n_dup_lines > t.text.count("\n") + 1),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 25 * t.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected rows per second, best first, measured on the ``sample_rows`` rows of smallest hash.

    Each rule is timed on a text whose measures are not yet known, so a shared measure counts for each of its rules.
    The order changes the cost alone: a text is kept if no rule rejects it.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, rows = batch.column(0).to_pylist(), []
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(rule.rejects(Text(text)) for text in texts)
                rows.append({"rule": k, "rejected": rejected, "seconds": time.perf_counter() - began})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rule", pa.int32()), ("rejected", pa.int64()), ("seconds", pa.float64())]))

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    found = small_batches(chosen).mapInArrow(probe, "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    gain = {row["rule"]: row["rejected"] / max(row["seconds"], 1e-9) for row in found.collect()}  # a row per rule
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k))]


def first_rejection(text: Text, ordered: Sequence[Rule]) -> str | None:
    """The name of the first rule that rejects the text; later rules are not evaluated."""
    return next((rule.name for rule in ordered if rule.rejects(text)), None)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures, base_failed, kept and rejected_by of every row.

    Null and empty texts have no words and fail the base rules. ``rejected_by`` is the rule that decided; which one it
    is of several that reject may differ between runs, as the order is measured. Repeated rows come back each, an empty
    table gives no rows, other columns are not read.
    """
    ordered = measured_order(docs, rules, sample_rows)
    base = [rule for rule in rules if rule.base]
    out = pa.schema(
        [("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = Text(value.as_py())
                by = first_rejection(text, ordered)
                failed = by is not None and any(rule.rejects(text) for rule in base)
                rows.append((doc_id, *(getattr(text, m) for m in MEASURES), failed, by is None, by))
            columns = zip(*rows, strict=True) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    measures = ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id long, {measures}, base_failed boolean, kept boolean, rejected_by string")
