"""Arrow helpers shared by the operators that run Python over whole texts."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a Python operator holds at a time. A longer text is a step of its own.
SLICE_BYTES = 4 << 20
#: Partitions of a shuffle by bucket at most; a task goes through its buckets one after another.
MOST_PARTS = 20_000


def release() -> None:
    """Give memory that this worker has freed back to the system: workers outlive their tasks, and the next stage's share the executor with the JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call, memory is only returned later
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches so that each piece has about ``limit`` bytes of text (one row at least).

    Null texts count and read as empty; a binary column is cut in the same way. Yields ``(piece, texts)``.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = pa.large_binary() if pa.types.is_binary(batch.schema.field(column).type) else pa.large_string()
        texts = pc.fill_null(batch.column(column).cast(kind), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
        release()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, coded.

    Returns the distinct words of these texts, each word's code in reading order, and
    ``bounds`` (one longer than ``texts``): text i has the words ``bounds[i]:bounds[i + 1]``.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def strings(values: pa.Array) -> list:
    """Python strings, or bytes, of an array; several times as fast as ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def joined(values: pa.Array, between: str) -> str:
    """All strings of an array in one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string()))
    return pc.binary_join(whole, between)[0].as_py()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products of hashes spread well."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts_of(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first row, row after the last) of each bucket that has rows, of sorted numbers: work that grows with the rows, not with the buckets."""
    if not len(bucket):
        return []
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True))


def bounded_parts(buckets: int) -> int:
    return min(buckets, MOST_PARTS)
