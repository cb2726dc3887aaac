"""Driver-side rows (settings, instruments, folds) as tables of known size."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """Rows as a local relation.

    Its size is known when the plan is made, so Spark broadcasts it only while it stays under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond; an RDD of Python rows would have
    no size and always be shuffled.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = []
    for i, field in enumerate(struct.fields):
        values = [row[i] for row in rows]
        if isinstance(field.dataType, T.MapType):
            values = [None if v is None else list(v.items()) for v in values]
        columns.append(values)
    arrow = to_arrow_schema(struct)
    table = pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, struct)
