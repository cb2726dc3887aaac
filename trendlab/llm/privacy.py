"""Personal data: patterns find protected values, co-occurrence over the corpus finds the words that give them away."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from trendlab.llm.common import slices, small_batches
from trendlab.sources.sinks import stored

#: Kinds of spans in the order that sorts them; the last one is what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of a protected value that count as beside it.
WINDOW = 10
#: A word is disclosing if it gives away this share of what there is to know about a value (its information content).
DISCLOSURE = 0.95
#: A disclosing word is generalised to a prefix of so many characters that is not disclosing, else removed.
PREFIXES = (3, 32)
#: Bits of the filter that preselects disclosing words in texts: its size is fixed, so what is broadcast is bounded.
FILTER_BITS = 1 << 23
#: Distinct words and pairs a task holds before it hands on their counts.
HELD = 1 << 17

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign is looked at once: the address is the run of name characters before it and the domain behind it."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
                at = end - 1
        at += 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255. A match that fails the test is not tried again from a later digit."""
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all pattern matches, by start, then kind; those of several kinds may overlap."""
    found = []
    for kind, (finder, sign) in enumerate(((emails, "@"), (ips, "."), (cards, ""), (phones, "+"))):
        if sign in text:
            found.extend((a, kind, b) for a, b in finder(text))
    return sorted(found)


def value(text: str, kind: int) -> str:
    """What makes two mentions the same protected value: an address in lower case, otherwise the digits (and dots)."""
    if KINDS[kind] == "email":
        return f"email:{text.lower()}"
    return f"{KINDS[kind]}:" + "".join(c for c in text if c in "0123456789." and (c != "." or KINDS[kind] == "ip"))


def _signed(data: bytes) -> int:
    """Spark's xxhash64 of the same bytes."""
    h = xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end) of the words that share no character with a span."""
    words = [(m[0].lower(), m.start(), m.end()) for m in _TERM.finditer(text)]
    if not spans:
        return words
    taken = np.array([(a, b) for a, _, b in spans])
    first, last = np.array([w[1] for w in words], np.int64), np.array([w[2] for w in words], np.int64)
    order, reach = np.sort(taken[:, 0]), np.maximum.accumulate(taken[np.argsort(taken[:, 0], kind="stable"), 1])
    before = np.searchsorted(order, last, side="left") - 1  # the last span that starts before the word's end
    inside = (before >= 0) & (reach[np.maximum(before, 0)] > first)
    return [w for w, gone in zip(words, inside.tolist(), strict=True) if not gone]


def beside(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> Iterator[tuple[int, str, int, int]]:
    """(value, word, places, context) for the words within ``window`` words of a mention of a value.

    ``places`` counts a word's places beside any mention of the value once each; a mention's context is a hash of its
    window, so the same passage in several texts is one context. A word with several mentions gets a row for each.
    """
    words = words_outside(text, spans)
    starts = [w[1] for w in words]
    seen: set[tuple[int, int]] = set()
    for a, kind, b in spans:
        name = _signed(value(text[a:b], kind).encode())
        at = int(np.searchsorted(starts, a))
        low, high = max(0, at - window), min(len(words), at + window)
        context = _signed(" ".join(w[0] for w in words[low:high]).encode())
        places: Counter[str] = Counter()
        for k in range(low, high):
            places[words[k][0]] += (name, k) not in seen
            seen.add((name, k))
        for word, n in places.items():
            yield name, word, n, context


_COUNTED = pa.schema([("value", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("context", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of words beside values with their contexts, handed on whenever a task holds many."""
    total: Counter[str] = Counter()
    near: Counter[tuple[int, str, int]] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        keys = [*((None, w, None) for w in total), *near]
        amounts = [*total.values(), *near.values()]
        columns = [[k[0] for k in keys], [k[1] for k in keys], amounts, [k[2] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)
        total.clear()
        near.clear()

    for batch in slices(batches):
        for item in batch.column(0):
            text = item.as_py() or ""
            spans = base_spans(text)
            if spans:
                total.update(w[0] for w in words_outside(text, spans))
                for name, word, n, context in beside(text, spans, window):
                    near[name, word, context] += n
            else:
                total.update(map(str.lower, _TERM.findall(text)))
            if len(total) + len(near) > HELD:
                yield from rows()
    if total or near:
        yield from rows()


def cooccurrence(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """value, word, n, several: how often each word stands beside each value; with null as value, how often at all.

    ``several`` says whether the word and the value were met in two or more different contexts.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = small_batches(texts).mapInArrow(lambda b: _count(b, window), "value long, word string, n long, context long")
    return counted.groupBy("value", "word").agg(F.sum("n").alias("n"), F.coalesce(F.min("context") != F.max("context"), F.lit(False)).alias("several"))


def _disclosing(pairs: DataFrame, totals: DataFrame, values: DataFrame, size: int, least: float) -> DataFrame:
    """word, value, disclosure of those ``pairs`` (value, word, n) that reach ``least``; ``size`` is N.

    With N places in the corpus, n_v of them beside value v, n_w held by word w and n_vw both, the disclosure is
    PMI(w, v) / IC(v) = log(N n_vw / (n_v n_w)) / log(N / n_v): 1 if w never stands elsewhere, 0 if it says nothing.
    """
    known, places = pairs.join(values, "value").join(totals, "word"), F.lit(float(size))
    gain = F.log(places / F.col("n_v") * (F.col("n") / F.col("n_w")))
    share = F.try_divide(gain, F.log(places / F.col("n_v")))
    return known.withColumn("disclosure", share).where(F.col("disclosure") >= least).select("word", "value", "disclosure")


def disclosing_words(counts: DataFrame, least: float = DISCLOSURE, prefixes: tuple[int, int] = PREFIXES) -> DataFrame:
    """word, disclosure (largest), n_values, replacement of the words that give a protected value away.

    A word counts if it was met beside the value in several contexts; what stands once beside a value proves nothing.
    The replacement is the word's longest prefix, of a length within ``prefixes`` and shorter than the word, that gives
    no value away, with a star; it is empty where there is none: the word is removed.
    """
    totals = counts.where("value is null").select("word", F.col("n").alias("n_w"))
    values = counts.where("value is not null").groupBy("value").agg(F.sum("n").alias("n_v"))
    size = totals.agg(F.sum("n_w")).first()[0] or 0
    pairs = counts.where("several").select("value", "word", "n")
    flagged = stored(
        _disclosing(pairs, totals, values, size, least).groupBy("word").agg(F.max("disclosure").alias("disclosure"), F.count("*").alias("n_values")), "disclosing"
    )
    shortest, longest = prefixes
    lengths = lambda most: F.sequence(F.lit(shortest), F.least(most, F.lit(longest)))
    tried = flagged.where(F.length("word") > shortest).select(
        F.col("word").alias("whole"), F.explode(F.transform(lengths(F.length("word") - 1), lambda k: F.col("word").substr(F.lit(1), k))).alias("word")
    )
    roots = tried.select(F.col("word").substr(1, shortest).alias("root")).distinct()
    wanted = tried.select("word").distinct()
    parts = (
        counts.where(F.length("word") >= shortest)
        .withColumn("root", F.col("word").substr(1, shortest))
        .join(roots, "root", "left_semi")
        .select("value", "n", F.explode(F.transform(lengths(F.length("word")), lambda k: F.col("word").substr(F.lit(1), k))).alias("word"))
        .join(wanted, "word", "left_semi")
        .groupBy("value", "word")
        .agg(F.sum("n").alias("n"))
    )
    of_prefix = parts.where("value is null").select("word", F.col("n").alias("n_w"))
    unsafe = _disclosing(parts.where("value is not null"), of_prefix, values, size, least).select("word").distinct()
    best = tried.join(unsafe, "word", "left_anti").groupBy("whole").agg(F.max(F.struct(F.length("word").alias("k"), F.col("word").alias("prefix"))).alias("best"))
    return flagged.join(best, flagged["word"] == best["whole"], "left").select(
        "word", "disclosure", "n_values", F.coalesce(F.concat(F.col("best.prefix"), F.lit("*")), F.lit("")).alias("replacement")
    )


@dataclass(frozen=True)
class WordFilter:
    """Two bits per word: a word without both is not in the set. Of fixed size, whatever the number of words."""

    bits: bytes

    @classmethod
    def of(cls, words: DataFrame) -> WordFilter:
        """Bits are put together in a distributed aggregation; at most ``FILTER_BITS / 64`` numbers reach the driver."""
        h = F.xxhash64("word")
        place = F.explode(F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS)))).alias("place")
        cells = words.select(place).groupBy(F.floor(F.col("place") / 64).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        packed = np.zeros(FILTER_BITS // 64, np.int64)
        for row in cells.toLocalIterator():
            packed[row["cell"]] = row["bits"]
        return cls(packed.tobytes() if packed.any() else b"")

    def maybe(self, words: list[str]) -> set[str]:
        if not self.bits or not words:
            return set()
        cells = np.frombuffer(self.bits, np.int64)
        h = np.array([_signed(w.encode()) for w in words], np.int64)
        hit = np.ones(len(words), bool)
        for place in (h % FILTER_BITS, (h >> 32) % FILTER_BITS):
            hit &= (cells[place >> 6] >> (place & 63)) & 1 == 1
        return {words[k] for k in np.flatnonzero(hit).tolist()}


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_WORD = pa.struct([("word", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS, _WORDS = "array<struct<start:long,kind:int,end:long>>", "array<struct<word:string,start:long,end:long>>"


def _find(batches: Iterator[pa.RecordBatch], chosen: WordFilter) -> Iterator[pa.RecordBatch]:
    """Column 0 as it is; then a key of id and text, the base spans and the places of words that pass the filter."""
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(2).to_pylist()]
        vocabulary = set().union(*({*map(str.lower, _TERM.findall(t))} for t in texts)) if chosen.bits else set()
        maybe, keys, bases, extras = chosen.maybe(sorted(vocabulary)), [], [], []
        for doc_id, text in zip(batch.column(1).to_pylist(), texts, strict=True):
            spans = base_spans(text)
            words = words_outside(text, spans) if maybe else []
            keys.append(md5(f"{doc_id}|{text}".encode()).digest())
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            extras.append([{"word": w, "start": a, "end": b} for w, a, b in words if w in maybe])
        columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(bases, pa.list_(_SPAN)), pa.array(extras, pa.list_(_WORD))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "base", "maybe"])


def spans_of(docs: DataFrame, row: Column, window: int = WINDOW, least: float = DISCLOSURE) -> DataFrame:
    """row, base (spans of the patterns) and added (start, end, replacement of disclosing words) for each row of ``docs``.

    ``row`` is what each row hands on. Texts are read twice: once to count, once to find; nothing is collected but the
    filter's bits. Words that pass the filter are compared exactly in a join on the word, and come back by a key of id
    and text: rows equal in both have equal spans, so they may share what is found.
    """
    counts = stored(cooccurrence(docs, window), "cooccurrence")
    flagged = stored(disclosing_words(counts, least), "disclosing-words")
    chosen = WordFilter.of(flagged)
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = StructType([rows.schema["row"], *StructType.fromDDL(f"key binary, base {_SPANS}, maybe {_WORDS}").fields])
    found = stored(small_batches(rows).mapInArrow(lambda b: _find(b, chosen), out), "spans")
    places = found.where(F.size("maybe") > 0).select("key", F.explode("maybe").alias("m")).select("key", "m.word", "m.start", "m.end").distinct()
    added = (
        places.join(flagged.select("word", "replacement"), "word")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("added"))
    )
    empty = F.array().cast("array<struct<start:long,end:long,replacement:string>>")
    return found.join(added, "key", "left").select("row", "base", F.coalesce("added", empty).alias("added"))


def _written(spans: Column) -> Column:
    """kind:start:end of an array of (start, kind, end), comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, window: int = WINDOW, least: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base (text of the pattern spans) and spans (of all spans) of every row.

    Pattern spans are leftmost and do not overlap within a kind. Added spans are words that give a protected value away
    (:func:`disclosing_words`), wherever in the corpus they stand outside pattern spans. Null and empty texts have no spans
    and count as nothing. Texts of any length are read whole. Repeated rows count each time they stand in the table, though
    one passage in several texts is one context; they come back each. Null ids stay null. An empty table gives no rows.
    Other columns are not read.
    """
    found = spans_of(docs, F.col("doc_id").cast("long"), window, least)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    term = KINDS.index("term")
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(term).alias("kind"), s["end"].alias("end")))
    return found.select(
        F.col("row").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:term])],
        F.size("added").cast("long").alias("n_term"),
        _written(F.col("base")).alias("base"),
        _written(F.array_sort(F.concat("base", more))).alias("spans"),
    )


def _cleaned(text: str | None, base: list[dict], added: list[dict]) -> str | None:
    """The text with a label for each stretch of overlapping pattern spans, and disclosing words generalised or removed."""
    marks = sorted([(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base] + [(s["start"], s["end"], s["replacement"]) for s in added])
    if text is None or not marks:
        return text
    out, end = [], 0
    for a, b, label in marks:
        if a >= end:
            out += [text[end:a], label]
        end = max(end, b)
    return "".join([*out, text[end:]])


def sanitised(docs: DataFrame, window: int = WINDOW, least: float = DISCLOSURE) -> DataFrame:
    """``docs`` with all its columns, its texts without personal data: patterns become ``<EMAIL>``, ``<IP>``, ``<CARD>`` or
    ``<PHONE>``, disclosing words their replacement. Cases as in :func:`personal_data`; a null text stays null.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names, place = docs.columns, docs.columns.index("text")
    found = spans_of(docs, F.struct(*[F.col(f"`{n}`") for n in names]), window, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(0).field(place).to_pylist()
            made = map(_cleaned, texts, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            columns = batch.column(0).flatten()
            columns[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(found).mapInArrow(run, docs.schema)
