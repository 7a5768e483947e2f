"""Vectorised word and shingle hashing over Arrow string batches.

The kernels work on the raw UTF-8 buffer of a batch with numpy, so no Python object is made per word.  Words are
maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes never occur inside a multi-byte UTF-8
sequence, so byte positions and characters agree.  ``A-Z`` are lower-cased, nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays (about 60 bytes per byte of text).
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all input bits (wraps modulo 2**64)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256)
    low[65:91] += 32
    value = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[low]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value[space] = 0
    return value, space


VALUE, SPACE = _tables()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of about ``limit`` bytes: first row, bytes, row offsets from 0.

    A null row has no bytes.  A row is never cut, so a longer row forms a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(bufs[2]) else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for each row, the index of its first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter sequence is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : len(hashes) - k + 1 + i]
    return mix(out + _U(k))


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every row."""
    for first, data, offsets in slices(texts):
        starts, ends, bounds = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], n))
