"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlab.llm.common import small_batches, utf8

#: The template: ``<s>role\ntext</s>\n`` per turn. Fixed values.
OPEN, ROLE_END, CLOSE = "<s>", "\n", "</s>\n"
#: Control strings that a text may not contain as they are; a backslash after their first character breaks them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
#: Bytes of a conversation after which it goes on in a further row.
PART_BYTES = 1 << 24

_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", _LOSS)])


def escape(texts: pa.Array) -> pa.Array:
    """Double each backslash, then break every control string with one; :func:`unescape` undoes it."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _scatter(out: np.ndarray, to: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the rows of a string column to the places ``to`` of ``out``."""
    sizes = np.diff(offsets)
    out[np.repeat(to - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])] = flat[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray, trained: str = "assistant") -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and the byte spans of their trained texts. ``firsts``: the row at which each begins."""
    names = pc.replace_substring(escape(roles), "\n", "\\\n")
    heads = pc.binary_join_element_wise(pa.scalar(OPEN), names, pa.scalar(ROLE_END), pa.scalar(""))
    (head, head_at), (body, body_at) = utf8(heads), utf8(escape(texts))
    close, n = np.frombuffer(CLOSE.encode(), np.uint8), len(roles)
    sizes = np.column_stack((np.diff(head_at), np.diff(body_at), np.full(n, len(close)))).ravel()
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(offsets[-1], np.uint8)
    _scatter(out, offsets[:-1:3], head, head_at)
    _scatter(out, offsets[1::3], body, body_at)
    out[(offsets[2::3, None] + np.arange(len(close))).ravel()] = np.tile(close, n)

    bounds = offsets[3 * np.append(firsts, n)]
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out)).cast(pa.string())
    is_trained = np.asarray(pc.equal(roles, trained).to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(is_trained)
    base = np.repeat(bounds[:-1], np.diff(np.append(firsts, n)))
    starts = offsets[1::3] - base
    spans = pa.StructArray.from_arrays([pa.array(starts[rows]), pa.array((starts + sizes[1::3])[rows])], fields=list(_LOSS.value_type))
    ends = np.searchsorted(rows, np.append(firsts, n)).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(ends), spans)


def format_conversations(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, formatted, loss (byte spans of the assistant texts) of every conversation.

    Turns are in order of turn, then role, then text; nulls come first. Null roles and texts are empty. Repeated rows
    are turns of their own. A null conv_id is one conversation. Rows are sorted within partitions and read as a stream:
    a conversation of more than ``part_bytes`` goes on in rows with a higher ``part`` in the same partition, one after
    another, so no group is held whole. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        part = 0  # of the first conversation in held
        sent: list[int | None] = []  # conv_id of rows that were emitted before the end of their conversation was seen

        def made(rows: pa.Table, part: int) -> pa.RecordBatch:
            ids, firsts = _runs(rows)
            formatted, loss = assemble(rows["role"].combine_chunks(), rows["text"].combine_chunks(), firsts)
            parts = np.zeros(len(firsts), np.int32)
            parts[0] = part
            return pa.RecordBatch.from_arrays([ids.take(pa.array(firsts)), pa.array(parts), formatted, loss], schema=_PARTS)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.set_column(1, "role", pc.fill_null(rows["role"], "")).set_column(2, "text", pc.fill_null(rows["text"], ""))
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not len(held):
                continue
            if sent:
                part, sent = part + 1 if held["conv_id"][0].as_py() == sent[0] else 0, []
            last = int(_runs(held)[1][-1])
            if last:
                yield made(held.slice(0, last), part)
                held, part = held.slice(last).combine_chunks(), 0
            if held.nbytes > part_bytes:
                yield made(held, part)
                held, sent = held.slice(0, 0), [held["conv_id"][0].as_py()]
        if held is not None and len(held):
            yield made(held, part)

    def _runs(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        ids = rows["conv_id"].combine_chunks()
        null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])))
        return ids, np.flatnonzero(new)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return small_batches(ordered).mapInArrow(run, "conv_id long, part int, formatted string, loss array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`format_conversations` holds, read back from its text: a row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The parts of a conversation follow each
    other in a partition, so their digests run on.
    """
    out = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None

        def row(at: list) -> tuple:
            return (at[0], at[1], at[2].hexdigest(), at[3], at[4].hexdigest(), at[5])

        for batch in batches:
            rows = []
            for conv_id, part, text, loss in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part == 0:
                    if at:
                        rows.append(row(at))
                    at = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    at[1] += 1
                    at[2].update(f"{role}\n{said}\n".encode())
                data = text.encode()
                for span in loss:
                    said = unescape(data[span["start"] : span["end"]].decode())
                    at[3] += len(said)
                    at[4].update(said.encode())
                at[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row(at), out, strict=True)], schema=out)

    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return small_batches(formatted).mapInArrow(run, fields)
