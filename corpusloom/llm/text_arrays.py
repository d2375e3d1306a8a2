"""Batches of UTF-8 texts as numpy arrays.

The helpers work on the byte buffer of an Arrow string column, so that words,
shapes and hashes of a whole batch are found by a few vector operations.  White
space is the six ASCII characters 0x20 and 0x09-0x0D; a word is a maximal run of
anything else inside one text.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries
    _TRIM = None

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    lengths = np.frombuffer(_lengths(batch.column(column)), np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more entry than texts)."""
    lengths = np.frombuffer(_lengths(column), np.int64)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, own, data = column.buffers()
    if data is None or not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    bounds = np.frombuffer(own, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    if column.null_count and len(data) != offsets[-1]:  # nulls may keep bytes
        keep = np.concatenate([np.arange(a, b) for a, b, n in zip(bounds[:-1], bounds[1:], lengths, strict=True) if n] or [np.zeros(0, np.int64)])
        data = data[keep - bounds[0]]
    return data, offsets


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random unsigned 64-bit integers of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1); made anew each time, as keeping them for each base would hold more memory than the time is worth."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(powers, out=powers)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of ``values[start:end]`` for all spans at once: polynomials modulo 2**64 by prefix sums, then mixed with the length."""
    base = int(stream(seed, 1)[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
        found = (prefix[ends] - prefix[starts]) * _powers(inverse, len(values) + 1)[starts]
        return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(stream(seed + 101, 256)[data], starts, ends, seed)


def window_hashes(hashes: np.ndarray, first: np.ndarray, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every window of ``length`` words that lies inside one text."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.ones(n, bool)
    for back in range(1, length):
        at = first[1:] - back
        inside[at[at >= np.maximum(first[:-1], 0)]] = False
    starts = np.flatnonzero(inside)
    return starts, span_hashes(hashes, starts, starts + length, seed)
