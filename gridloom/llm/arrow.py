"""Arrow batches in Python workers: slices of bounded bytes, and texts as UTF-8."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trim() -> None:
    """Gives back to the system what earlier tasks of this worker have freed (where the C library can)."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches, of: str | Callable, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column (by name, or what a function of the batch gives) has about `most` bytes in each (one row at least), without a copy."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = of(batch) if callable(of) else column(batch, of)
        sizes = np.cumsum(lengths(texts))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(texts: pa.Array) -> list[bytes]:
    """Each value's bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in (texts.cast(kind) if not pa.types.is_binary(texts.type) else texts).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(values: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """A list array of these values, dealt out by these sizes."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] values, then those of starts[1], and so on."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before, counts) + np.repeat(np.asarray(starts, np.int64), counts)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs (touching ones join), in order."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return starts[new], ends[last]
