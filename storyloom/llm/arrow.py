"""Arrow batches cut into pieces of bounded bytes, and ragged arrays in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once in a Python worker; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.diff(byte_offsets(col)[0])
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            base = ends[at] - size[at]
            end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, whose worker gives its free memory back when a task ends: workers idle beside the JVM through the next stages."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def byte_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text (nulls empty) within its bytes, from 0, and the bytes."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.empty(0, np.uint8)
    return o - o[0], d


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], flat[starts[1]:...], ... in one array."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    shift += np.arange(total, dtype=shift.dtype)
    return flat[shift]


class Ragged:
    """A growing list of number arrays, kept flat."""

    def __init__(self, dtype) -> None:
        self.flat, self.n = np.empty(1 << 16, dtype), 0
        self.start, self.length, self.rows = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def extend(self, lengths: np.ndarray, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.start[self.rows : self.rows + len(lengths)] = self.n + np.cumsum(lengths) - lengths
        self.length[self.rows : self.rows + len(lengths)] = lengths
        self.flat[self.n : self.n + len(values)] = values
        self.n, self.rows = self.n + len(values), self.rows + len(lengths)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths, and the values one after the other, of the rows in index."""
        length = self.length[index]
        return length, gather(self.start[index], length, self.flat)


def binary_array(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Consecutive slices of ``values`` (the i-th ends before element ends[i]) as binary."""
    offs = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def as_binary(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return binary_array(ends, values).cast(pa.binary())
