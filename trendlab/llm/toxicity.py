"""Toxicity: obfuscated words are restored by a noisy-channel Viterbi decoder, then scored with a learned lexicon."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import slices, small_batches

#: Labelled rows of each class that may train the lexicon: those with the smallest hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 4000, 12000
#: A feature needs this many toxic rows, this lower bound of its precision, and so many newly explained toxic rows, or
#: one if it is common; a clean row outweighs several toxic ones.
LEAST_ROWS, LEAST_PRECISION, LEAST_NEW, COMMON_ROWS, CLEAN_WEIGHT = 4, 0.7, 3, 20, 4
#: A feature that explains nothing new is taken if it is this precise and stands beside so many different sets of others.
MORE_PRECISION, MORE_SETS = 0.95, 10
#: Lengths of word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 8)
#: Distinct words whose restored form a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 1 << 17
#: Bytes of text whose features are counted together in training.
TRAIN_BYTES = 1 << 19

# Letters that a character may stand for, and characters that may stand between the letters of a word.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c", "€": "e", "£": "l", "¡": "i",
}
BETWEEN = set(".-_~'`,:;/\\ ·​‌‍­")
#: Costs of the channel: a stand-in character, a character between letters, a repeated letter dropped or kept, and a symbol at either end dropped.
SWAP, DROP, REPEAT, KEEP, END = 1.0, 0.5, 0.2, 2.0, 1.5

#: Symbols of the language model: 0 is no letter, 1 to 26 are a to z, 27 is any other letter.
SIGNS = 28
_SPACED = re.compile(r"(?<!\S)(?:\S[ .\-_]){3,}\S(?!\S)")
_EDGES = re.compile(r"^[^\w@$!|+(€£¡*]+|[^\w]{3,}$|[^\w$@€]+$")
_RUN = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[a-z].*[a-z]", re.DOTALL)
_ODD = re.compile(r"[^\W\d_]*")


def _byte_signs() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(1, 27)
    table[0xC3:0x100] = 27  # the first byte of a letter outside ASCII; the bytes that follow it are left out
    return table


class LanguageModel:
    """Log probabilities of a sign after two others, with add-one-half smoothing."""

    def __init__(self, counts: np.ndarray) -> None:
        cube = counts.reshape(SIGNS, SIGNS, SIGNS) + 0.5
        self.logs = np.log(cube / cube.sum(axis=2, keepdims=True)).tolist()

    @staticmethod
    def sign(letter: str) -> int:
        code = ord(letter)
        return code - 96 if 97 <= code <= 122 else 27 if letter.isalpha() else 0


def language_model(docs: DataFrame) -> LanguageModel:
    """Counts of three signs in a row over all texts; at most 28 x 28 x 28 sums reach the driver."""
    signs = _byte_signs()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**3, np.int64)
        for batch in slices(batches):
            for text in batch.column(0):
                data = np.frombuffer(b" " + (text.as_py() or "").encode() + b" ", np.uint8)
                s = signs[data[(data < 0x80) | (data >= 0xC3)]]
                total += np.bincount((s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:], minlength=SIGNS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["signs", "n"])

    sums = small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "signs long, n long").groupBy("signs").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIGNS**3)
    for row in sums.collect():
        counts[row["signs"]] = row["n"]
    return LanguageModel(counts)


def _options(word: str) -> list[list[tuple[str, float]]]:
    """The lattice of a word: per character, the letters it may stand for with their cost; '' drops it."""
    out = []
    first, last = 0, len(word) - 1
    for k, c in enumerate(word):
        if c in LEET:
            options = [(letter, SWAP) for letter in LEET[c]]
            if not c.isalnum() and k in (first, last) or k and word[k - 1] == c:
                options.append(("", END))
        elif c in BETWEEN:
            options = [("", DROP)]
        elif c.isalpha():
            options = [("", REPEAT), (c, KEEP)] if k and word[k - 1] == c and _RUN.search(word) else [(c, 0.0)]
        else:
            options = [("", END)]
        out.append(options)
    return out


def viterbi(word: str, model: LanguageModel) -> str:
    """The likeliest letters behind a word: states are the last two letters."""
    logs, sign = model.logs, model.sign
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in _options(word):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in paths.items():
            for letter, cost in options:
                if letter:
                    c = sign(letter)
                    state, value = (b, c), (score - cost + logs[a][b][c], text + letter)
                else:
                    state, value = (a, b), (score - cost, text)
                if state not in after or value > after[state]:
                    after[state] = value
        paths = after
    return max((score + logs[a][b][0], text) for (a, b), (score, text) in paths.items())[1]


def restore(word: str, model: LanguageModel) -> str:
    """A lower-case word without edge punctuation; decoded if it holds stand-ins, separators or long repeats."""
    word = _EDGES.sub("", word)
    if _ODD.fullmatch(word) and not _RUN.search(word):
        return word
    if not _LETTERS.search(word):
        return ""
    return viterbi(word, model)


def words_of(text: str) -> list[str]:
    """Lower-case words split at white space, and runs of four or more single characters joined to one word each."""
    low = text.lower()
    return low.split() + [re.sub(r"[ .\-_]", "", run) for run in _SPACED.findall(low)]


def features(word: str) -> Iterable[str]:
    """The word itself (after a space) and its beginnings."""
    if len(word) >= PREFIXES[0]:
        yield " " + word
        for n in PREFIXES:
            if len(word) >= n:
                yield word[:n]


class Lexicon(dict):
    """word -> its features that the lexicon weighs; fills itself as words are met."""

    def __init__(self, weights: dict[str, float], model: LanguageModel) -> None:
        super().__init__()
        self.weights, self.model = weights, model

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        found = tuple(f for f in features(restore(word, self.model)) if f in self.weights)
        self[word] = found
        return found

    def hits(self, text: str) -> set[str]:
        return {f for word in set(words_of(text)) for f in self[word]}


@dataclass(frozen=True)
class Classifier:
    """Precision of each lexicon feature, and the rate of toxic texts without any."""

    weights: dict[str, float]
    base: float
    model: LanguageModel

    def score(self, hits: Iterable[str]) -> float:
        """The probability that at least one of the hit features, or the base rate, makes the text toxic."""
        rest = 1 - self.base
        for f in hits:
            rest *= 1 - self.weights[f]
        return 1 - rest


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _lower_bound(hits: int, misses: int) -> float:
    """Wilson's lower bound of hits / (hits + misses) at one standard error and a half."""
    n, z = hits + misses, 1.5
    p = hits / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """label and text of the labelled rows that may train, one of equal texts, bounded per class by hash order."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    first = lambda label, n: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(first(1, toxic_rows).unionByName(first(0, clean_rows)))  # at most toxic_rows + clean_rows ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("label", "text")
    return rows.where("text is not null").dropDuplicates(["label", "text"])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Classifier:
    """Learn the lexicon: frequent, precise features, taken greedily while they explain toxic rows not yet explained.

    A word that only a group of copies shares explains nothing that the words making them toxic don't, and stays out.
    Without labels of both classes the lexicon is empty and every score is the base rate.
    """
    model = language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored: dict[str, str] = {}
        for batch in slices(batches, TRAIN_BYTES):
            counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            if len(restored) > REMEMBERED_WORDS:
                restored.clear()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set()
                for word in set(words_of(text)):
                    if word not in restored:
                        restored[word] = restore(word, shared.value)
                    found.update(features(restored[word]))
                counts[label].update(found)
            for label, counter in counts.items():
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counter)), pa.array([label] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())],
                        names=["feature", "label", "n"],
                    )

    rows = training_rows(docs, labels, toxic_rows, clean_rows)
    sums = small_batches(rows).mapInArrow(count, "feature string, label int, n long").groupBy("feature")
    sums = sums.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    frequent = sums.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") > F.col("clean"))).collect()  # bounded by the rows in training
    candidates = {r["feature"]: (r["toxic"], r["clean"]) for r in frequent if _lower_bound(r["toxic"], r["clean"]) >= LEAST_PRECISION}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(dict.fromkeys(candidates, 1.0), shared.value)
        for batch in slices(batches):
            found = [sorted(lexicon.hits(text)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["found"])

    toxic = [r["found"] for r in small_batches(rows.where("label = 1").select("text")).mapInArrow(find, "found array<string>").collect()]  # at most toxic_rows
    weights = {f: (candidates[f][0] + 0.1) / (sum(candidates[f]) + 0.2) for f in _cover(toxic, candidates)}
    unexplained = sum(not set(weights) & set(f) for f in toxic)
    return Classifier(weights, min(0.4, (unexplained + 0.5) / (unexplained + clean_rows)), model)


def _cover(rows: list[list[str]], candidates: dict[str, tuple[int, int]]) -> list[str]:
    """Candidates by the rows they newly explain, less clean ones; of equal ones the commoner, then the longer.

    Then the common and precise ones that stand beside many different sets of those: a word that only a group of
    copies shares always stands beside the same few.
    """
    holding: dict[str, set[int]] = {}
    for k, found in enumerate(rows):
        for f in found:
            holding.setdefault(f, set()).add(k)
    taken, left = [], set(range(len(rows)))

    def useful(f: str) -> bool:
        new = len(holding[f] & left)
        return new >= (1 if candidates[f][0] >= COMMON_ROWS else LEAST_NEW) and new > CLEAN_WEIGHT * candidates[f][1] * new / candidates[f][0]

    while holding := {f: ks for f, ks in holding.items() if useful(f)}:
        best = max(holding, key=lambda f: (len(holding[f] & left) - CLEAN_WEIGHT * candidates[f][1], candidates[f][0], len(f), f))
        taken.append(best)
        left -= holding[best]
    beside: dict[str, set[frozenset[str]]] = {}
    for found in rows:
        explained = frozenset(set(found).intersection(taken))
        for f in found:
            beside.setdefault(f, set()).add(explained)
    more = [f for f, sets in beside.items() if len(f) > PREFIXES[0] and len(sets) >= MORE_SETS and candidates[f][0] >= COMMON_ROWS and _lower_bound(*candidates[f]) >= MORE_PRECISION]
    return [*taken, *sorted(set(more).difference(taken))]


def scores(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row.

    Null and empty texts get the base rate. Repeated rows come back each, an empty table gives no rows, other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        lexicon = Lexicon(by.weights, by.model)
        for batch in slices(batches):
            found = [by.score(sorted(lexicon.hits(text.as_py() or ""))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = small_batches(rows).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5; all columns kept.

    Null and empty texts have no features and score as such. Each of repeated rows is judged by itself, and alike; texts of any
    length are scored whole; an empty table gives no rows.
    """
    classifier = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        lexicon = Lexicon(by.weights, by.model)
        for batch in slices(batches):
            keep = [by.score(sorted(lexicon.hits(text.as_py() or ""))) < 0.5 for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
