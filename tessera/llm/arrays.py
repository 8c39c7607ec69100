"""Whole Arrow text columns as numpy arrays, inside one task.

Everything here works on one slice of a task's own Arrow batches; Spark does the dealing.
A slice holds ``SLICE_BYTES`` of text, or one text where that text alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
PART_BYTES = 1 << 20


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has about ``limit`` bytes of text; no text is cut.

    After the last, what the worker no longer uses goes back to the system: idle workers stay small.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text) if text in batch.schema.names else batch.column(text.split(".")[0]).field(text.split(".")[1])
        ends = np.cumsum(lengths(column), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(low, high - low)
            low = high
    release()


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column, and n+1 offsets; null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_position = [np.zeros(0, np.uint64)]


def position_keys(n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers, one for each position within a word."""
    if len(_position[0]) < n:
        k = np.arange(1 << max(10, int(n - 1).bit_length()), dtype=np.uint64)
        _position[0] = mix(k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)) | np.uint64(1)
    return _position[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true that don't cross an offset."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(member)]
    begins[cuts] = member[cuts]
    ends = np.empty_like(member)
    ends[:-1] = member[:-1] & ~member[1:]
    ends[-1] = member[-1]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = member[cuts]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each values[start:end]: a random linear sum over positions, then mixed.

    Some ``PART_BYTES`` at a time, or one longer value: each takes several 8-byte numbers.
    """
    done = np.concatenate([[0], np.cumsum(ends - starts)])
    if done[-1] <= PART_BYTES:
        return _hashes(values, starts, ends)
    cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1], PART_BYTES)).clip(0, len(starts)))
    cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
    return np.concatenate([_hashes(values, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(first, size)
    if total == len(values) and starts[0] == 0:
        picked = values
    else:
        picked = values[within + np.repeat(starts, size)]
    keys = position_keys(int(size.max()))
    sums = np.add.reduceat((picked.astype(np.uint64) + np.uint64(1)) * keys[within], first)
    return mix(sums + size.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word keys and words by text; ``member`` says by byte value what words consist of."""
    starts, ends = runs(member[data], offsets)
    count = np.searchsorted(starts, offsets[1:], "left") - np.searchsorted(starts, offsets[:-1], "left")
    return starts, hashes(data, starts, ends), count


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


#: Words of the contamination contract: digits, letters and everything outside ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Words between white space of the near-duplicate contract.
SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of the little-endian unsigned 32-bit form of each data[start:end]."""
    from zlib import crc32

    view = memoryview(np.ascontiguousarray(data, dtype="<u4")).cast("B")
    return np.array([crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
