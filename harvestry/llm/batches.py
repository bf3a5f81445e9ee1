"""Arrow batches as byte arrays: slices of bounded size that numpy can work on at once."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 1 << 20


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text or binary column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    return pc.fill_null(column, b"") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column and the offsets of its values, counted from the first byte given."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system: workers are used again by the next stages, and what they hold adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if name := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(name), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most `limit` bytes or one row."""
    for batch in batches:
        column = texts(batch, name)
        data, at = raw(column)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
    release()


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
