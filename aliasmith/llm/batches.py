"""Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if value is None else value for value in column.cast(kind).to_pylist()]


def record_batch(columns: dict[str, Sequence], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) for c in types], list(types))


@cache
def _trim() -> Callable[[int], int] | None:
    """glibc's ``malloc_trim``, where there is one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def give_back() -> None:
    """Returns free memory to the system.

    Workers wait for their next task with what they once took, and the allocators keep most of it.
    """
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded size, so that a task holds few texts at a time.

    A piece has at most ``rows`` rows, and beyond its first row at most ``most_bytes`` bytes in
    columns of text. Memory of a batch that has been used is given back.
    """
    for batch in batches:
        upto = np.cumsum(_text_bytes(batch))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            stop = min(stop, start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        del batch, upto
        give_back()


def _text_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The bytes that each row holds in columns of text."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total
