"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries found by one repeated-capture match."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import slices, small_batches

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that stay plain, and of 100 others, those that start with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Code points matched at a time: a match keeps a number per unit, so a longer text is matched in pieces that end between units.
PIECE_CHARS = 1 << 20
#: A unit is a run of ASCII letters or one other character.  Every repetition of the group is kept as a capture.
_UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
_OTHER = regex.compile(r"[^A-Za-z]")


def unit_ends(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[int, list[int]]]:
    """(offset of a piece, ends of its units counted from there); one piece unless the text is longer than ``limit``."""
    start = 0
    while start < len(text):
        stop = start + limit
        if stop < len(text):
            last = _OTHER.search(text, stop - 1)  # a piece ends with a character that is a unit of its own
            stop = last.end() if last else len(text)
        piece = text if start == 0 and stop >= len(text) else text[start:stop]
        yield start, _UNITS.fullmatch(piece).ends(1)
        start = stop


def cut(text: str, h1: int, h2: int, limit: int = PIECE_CHARS) -> tuple[int, int, int]:
    """(number n of units, code points before the middle, code points up to its end): cuts after ``h % (n + 1)`` units."""
    if len(text) <= limit:
        ends = [0, *_UNITS.fullmatch(text).ends(1)]
        n = len(ends) - 1
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, ends[first], ends[second]
    n = sum(len(ends) for _, ends in unit_ends(text, limit))
    wanted = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, seen = [0, 0], 0
    for offset, ends in unit_ends(text, limit):
        for k, unit in enumerate(wanted):
            if seen < unit <= seen + len(ends):
                at[k] = offset + ends[unit - seen - 1]
        seen += len(ends)
    return n, at[0], at[1]


def transformed(doc_id: int | None, text: str, salt: str = "1:") -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; the choices are digests of its id."""
    digest = sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n, a, b = cut(text, h1, h2)
    if not text or h3 % 100 >= 100 - PLAIN_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    Null and empty texts have no units and stay plain with an empty output. A text that holds a mark stays plain, so
    marks in other outputs are always ours. A null doc_id chooses as an empty one. Equal ids choose alike, so repeated
    rows come back each with the same result. Texts over ``PIECE_CHARS`` are matched in pieces. An empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            rows = [(i, *transformed(i, text.as_py() or "")) for i, text in zip(ids, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; each mark stands in it once."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
