"""BPE encoding and decoding with an index of the positions of every pair."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import gathered, slices, small_batches

#: Words whose tokens a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 1 << 17
#: Bytes of text whose new words are merged together.
PARTITION_BYTES = 1 << 22

#: Bytes of ids that are decoded at a time.
DECODED_BYTES = 1 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others
    for the characters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Tokenizer:
    """A tokenizer file with NFC and lower-casing, a splitting pattern, byte-level symbols and merges with a word end."""

    def __init__(self, config: str) -> None:
        data = json.loads(config)
        model, steps = data["model"], data["pre_tokenizer"]["pretokenizers"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        end = model["end_of_word_suffix"]
        #: by rank: left, right and merged symbol
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        pairs = np.array([a << 32 | b for a, b, _ in self.merges])
        self.pair_rank = np.argsort(pairs)
        self.pairs = pairs[self.pair_rank]
        born = {}
        for r, (a, b, made) in enumerate(self.merges):
            if born.get(a, -1) >= r or born.get(b, -1) >= r:
                raise ValueError(f"merge {r} uses a symbol that a later merge makes")
            born.setdefault(made, r)
        symbols = byte_symbols()
        self.inner, self.last = (np.array([self.ids[c + e] for c in symbols]) for e in ("", end))
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> Iterable[str]:
        """The words of a text, in order; a special token is a piece of its own, marked by a leading space."""
        if self.cut is None or not self.cut.search(text):
            return self.pattern.findall(self.normal(text))
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [" " + part] if k % 2 else self.pattern.findall(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        # character by character: a capital sigma has one lower-case form wherever it stands
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        pairs = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.pair_rank[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words on end, and how many each has: the words of a partition are merged together.

        ``where`` maps the rank of each pair to all its positions. The lowest active rank is applied to all of them
        at once, and the pairs on both sides of a merged one enter the lists of their ranks. A merge only makes pairs
        of higher rank (checked when the file is read), so each rank is visited once.
        """
        data = [word.encode("utf-8", "surrogatepass") for word in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbol = self.inner[flat]
        symbol[ends - 1] = self.last[flat[ends - 1]]
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        after[ends - 1], before[ends - sizes] = -1, -1

        first = np.flatnonzero(after >= 0)
        found = self.ranks(symbol[first], symbol[first + 1])
        first, found = first[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        first, (active, cuts) = first[order], np.unique(found[order], return_index=True)
        where: dict[int, list] = {r: [at] for r, at in zip(active.tolist(), np.split(first, cuts[1:]), strict=True)} if len(first) else {}
        heap = list(where)
        while heap:
            r = heapq.heappop(heap)
            left, right, made = self.merges[r]
            lists = where.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            to = after[at]
            held = (symbol[at] == left) & (to >= 0) & (symbol[to] == right)
            at, to = at[held], to[held]
            if left == right:  # of overlapping pairs the left one counts
                alone, used = np.ones(len(at), bool), -1
                for k, (i, j) in enumerate(zip(at.tolist(), to.tolist(), strict=True)):
                    alone[k] = i != used
                    used = j if alone[k] else used
                at, to = at[alone], to[alone]
            if not len(at):
                continue
            following, previous = after[to], before[at]
            symbol[at], symbol[to], after[at] = made, -1, following
            inside = following >= 0
            before[following[inside]] = at[inside]
            lefts, rights = np.concatenate((at[inside], previous[previous >= 0])), np.concatenate((following[inside], at[previous >= 0]))
            new = self.ranks(symbol[lefts], symbol[rights])
            lefts, new = lefts[new >= 0], new[new >= 0]
            if len(new) > 1:
                order = np.argsort(new, kind="stable")
                lefts, (kinds, cuts) = lefts[order], np.unique(new[order], return_index=True)
                groups = zip(kinds.tolist(), np.split(lefts, cuts[1:]), strict=True)
            else:
                groups = zip(new.tolist(), [lefts], strict=False)
            for n, positions in groups:
                if n not in where:
                    heapq.heappush(heap, n)
                    where[n] = []
                where[n].append(positions)
        left_over = symbol >= 0
        return symbol[left_over].astype(np.uint32), np.add.reduceat(left_over, ends - sizes, dtype=np.int64) if len(data) else sizes

    def decode(self, ids: Iterable[int]) -> str:
        """The token strings joined by spaces, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


class _Index(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Memory:
    """Tokens of the words that a task has met."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Merge the words that have entered the index since the last call."""
        known = len(self.starts) - 1
        new = list(islice(self.index, known, None))
        flat, sizes = self.tokenizer.merge([w for w in new if w[0] != " "])
        for k, word in enumerate(new):
            if word[0] == " ":  # a special token is one token
                flat, sizes = np.insert(flat, sizes[:k].sum(), self.tokenizer.special[word[1:]]), np.insert(sizes, k, 1)
        self.flat = np.concatenate((self.flat, flat))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        if len(self.index) > REMEMBERED_WORDS:
            self.clear()
        index = self.index
        coded = [np.fromiter(map(index.__getitem__, self.tokenizer.pieces(t)), np.int32) for t in texts]
        self.learn()
        out = []
        for words in coded:
            first, sizes = self.starts[words], self.starts[words + 1] - self.starts[words]
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append(self.flat[np.repeat(first, sizes) + within])
        return out


def read_config(path: str) -> str:
    """The tokenizer file, a few MB, read at the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _tokenizer(rows: DataFrame, config: str) -> Callable[[], Tokenizer]:
    """A function that builds the tokenizer once in each task that calls it."""
    shared = rows.sparkSession.sparkContext.broadcast(config)
    made: list[Tokenizer] = []

    def get() -> Tokenizer:
        if not made:
            made.append(Tokenizer(shared.value))
        return made[0]

    return get


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
    memory = Memory(tokenizer)
    for batch in gathered(batches, PARTITION_BYTES):
        ids = memory.encode([t or "" for t in batch.column(1).to_pylist()])
        offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=_ENCODED)


def _decoded(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, DECODED_BYTES):
        texts = [tokenizer.decode(ids.as_py() or ()) for ids in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(_ENCODED.field(1).type), pa.array(texts, pa.string())], schema=_DECODED)


def _digested(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        first = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        second = [hashlib.sha256(t.as_py().encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column(2)]
        columns = [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(first, pa.string()), pa.array(second, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, ids], schema=_DIGESTS.append(_ENCODED.field(1))) if with_ids else pa.RecordBatch.from_arrays(columns, schema=_DIGESTS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, config: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; null text is empty. Repeated rows come back each, an empty table
    gives no rows, other columns are not read."""
    get = _tokenizer(docs, config)
    return small_batches(_texts(docs)).mapInArrow(lambda batches: _encoded(batches, get()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, config: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with their decoded text; null ids are empty."""
    get = _tokenizer(encoded, config)
    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(lambda batches: _decoded(batches, get()), "doc_id long, ids array<int>, decoded string")


def ids_digest(ids: Iterable[int]) -> str:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(np.fromiter(ids, "<u4").tobytes()).hexdigest()


def digests(docs: DataFrame, config: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row: all in one pass over the texts."""
    get = _tokenizer(docs, config)
    return small_batches(_texts(docs)).mapInArrow(
        lambda batches: _digested(_decoded(_encoded(batches, get()), get()), with_ids),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""),
    )
