"""Small helpers for Arrow-batched tasks (``mapInArrow``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; bounds its numpy buffers.
CHUNK_BYTES = 2 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches into slices of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(text).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)],
        schema=schema)


def binary_slices(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the bytes of values[offsets[i]:offsets[i+1]]."""
    data = np.ascontiguousarray(values)
    at = (np.asarray(offsets, np.int64) * data.itemsize)
    if at[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1,
                                     [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())])
    raise ValueError("a batch of more than 2 GB; lower CHUNK_BYTES")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
