"""Helpers of the text operators: rows through Arrow in bounded slices, and a key for each row.

Texts are handled as their UTF-8 bytes. A slice holds at most SLICE_BYTES of text unless one text alone is longer, so
a task's memory follows the longest text, not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowspark.llm.textops import release_tables

SLICE_BYTES = 2 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins (one more entry for the end); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about `limit` bytes of `column`."""
    values = text_of(batch, column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give back what a finished task leaves in its worker, which serves later tasks and other stages."""
    release_tables()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def with_columns(df: DataFrame, fields: StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]],
                 column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Add columns that `compute` derives from a slice of rows; columns of the same name are replaced."""
    names = {f.name.lower() for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = StructType(kept.schema.fields + fields.fields)

    def run(batches):
        batch = part = None
        try:
            for batch in batches:
                for part in slices(batch, column, limit):
                    yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=schema.names)
        finally:
            del batch, part
            release_memory()

    return kept.mapInArrow(run, schema)


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def row_key(*columns: str) -> Column:
    """128 bits of the given columns: the same for repeated rows, different for rows that merely share an id."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), *cols)) for seed in (1, 2)])


def as_list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Values and offsets as a list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
