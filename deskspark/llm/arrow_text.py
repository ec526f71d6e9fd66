"""Text columns inside Arrow tasks: bounded batches, raw bytes, and result batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, task: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow`` whose input batches end at about ``BATCH_BYTES``, whatever the rows hold."""
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each starts (one more offset at the end).

    Null texts count as empty. The bytes are a view on the Arrow buffer.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def batch_of(names: Sequence[str], columns: Sequence, types: Sequence[pa.DataType]) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) and c.type == t else pa.array(c, t) for c, t in zip(columns, types)
    ]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def pieces(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def id_and_text(docs: DataFrame, doc_id: str, text: str, keep_rows: bool) -> DataFrame:
    """``doc_id, text`` and, if asked for, all columns of the row in one struct."""
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *rows)


def with_rows(batch: pa.RecordBatch, told: pa.RecordBatch) -> pa.RecordBatch:
    """``told`` and the rows of ``batch`` if it has them."""
    return told.append_column("row", batch.column(2)) if batch.num_columns > 2 else told


def schema_with_rows(rows: DataFrame, told: str) -> StructType:
    fields = [rows.schema[0], *StructType.fromDDL(told).fields]
    return StructType([StructField(f.name, f.dataType) for f in [*fields, *rows.schema.fields[2:]]])
