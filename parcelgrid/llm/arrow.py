"""Arrow helpers the text operators share: blocks of bounded bytes and words as integer codes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as plain strings, null as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


@cache
def _trim():
    """The C library's call that returns freed memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return what was freed, so that idle workers beside the executor stay small."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_KEPT: list[Callable] = []


def kept(make: Callable) -> Callable:
    """``cache`` for what a worker keeps from task to task, until ``forget``."""
    _KEPT.append(cache(make))
    return _KEPT[-1]


def forget() -> None:
    """Drop what other operators keep in this worker, which Spark uses again for the tasks of the next one."""
    for made in _KEPT:
        made.cache_clear()
    give_back()


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``limit`` bytes; one longer text is a slice of its own.

    Rows keep their order and none is dropped, so memory follows the bytes of
    the texts and not the number of rows in Spark's batches.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch
        give_back()


def words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(all words one after another, offsets per row); words are runs of anything but ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets).astype(np.int64)
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), counts[offsets]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words)."""
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    if not len(flat):
        return np.zeros(0, np.int64), flat
    d = flat.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def strings(column: pa.Array) -> list[str]:
    """The column as Python strings, much faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_table(lower: bool = True, **classes: str) -> bytes:
    """A table for ``translated``: A-Z in lower case, ``space`` and ``line`` (characters of one byte) as a blank and a line feed."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = range(97, 123)
    for name, to in (("space", 32), ("line", 10)):
        for c in classes.get(name, ""):
            table[ord(c)] = to
    return bytes(table)


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """The texts with every byte below 128 replaced by ``table``; longer characters stay."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = memoryview(data)[at[0]: at[-1]].tobytes().translate(table) if data is not None else b""
    return pa.StringArray.from_buffers(len(column), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(held))
