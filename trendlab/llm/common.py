"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper-case and lower-case ASCII letters: fixed values of the contracts that lower-case A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have, whatever the case of its letters."""
    taken, found = {c.lower() for c in rows.columns}, f"_{name}"
    while found in taken:
        found += "_"
    return found


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Rows of an Arrow batch between Spark and Python: texts are long, and both sides hold whole batches outside the heap.
BATCH_ROWS = 1000


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose Arrow batches have at most ``BATCH_ROWS`` rows from now on."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return rows


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets


#: Bytes of a batch that are worked on at a time inside a task.
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes, so that memory does not follow the length of texts."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(batch.nbytes, limit))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``limit`` bytes; larger ones are cut as by :func:`slices`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, limit):
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def per_text(function: Callable[[bytes], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``function(text as UTF-8)`` gives the values that follow the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = utf8(batch.column(1))
            view = memoryview(flat)
            rows = [function(bytes(view[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column(0)]
            for k in range(1, len(schema)):
                columns.append(pa.array([r[k - 1] for r in rows], type=schema.field(k).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
