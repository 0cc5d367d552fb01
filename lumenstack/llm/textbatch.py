"""Arrow batches of texts as one byte array with offsets, for vectorised work inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def spare() -> None:
    """Give back to the system what Arrow's pool and the heap keep of freed memory: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(of_batches: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A generator of batches that leaves little memory behind in its worker."""

    @wraps(of_batches)
    def run(*args):
        spare()
        try:
            yield from of_batches(*args)
        finally:
            spare()

    return run


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of row i is bytes[offsets[i]:offsets[i + 1]]; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch, then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), names=keep + list(new))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of a column, or of one row; an empty batch stays."""
    for batch in batches:
        _, ends = byte_buffer(batch.column(column))
        first = 0
        while first < len(batch) or first == len(batch) == 0:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
