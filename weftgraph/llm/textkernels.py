"""Vectorised word and shingle kernels over the raw UTF-8 bytes of Arrow string columns.

Words are hashed without ever becoming Python objects: bytes are mapped to random 64-bit values,
a running sum of value * P**position is taken over a whole block of texts, and the hash of a word
is the difference of two running sums, shifted back to position 0. Blocks hold about BLOCK bytes of
whole texts, so memory is bounded by the larger of BLOCK and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            step = np.full(n, p, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_table(separators: bytes) -> np.ndarray:
    """Which bytes belong to words, given the bytes that don't."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text where its words begin (one more entry at the end)."""
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, at: np.ndarray, table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, concatenated, and their offsets.

    A text with fewer words than ``size``, but some, has its whole word sequence as its only shingle.
    """
    starts, ends, first = words(data, at, table)
    h = word_hashes(data, starts, ends)
    coefficient = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        runs += h[j : j + len(runs)] * coefficient[j]
    runs = mix(runs)
    out, offsets = [], np.zeros(len(at), np.int64)
    for d in range(len(at) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            part = np.unique(runs[a : b - size + 1])
        elif b > a:
            part = mix((h[a:b] * coefficient[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            part = runs[:0]
        out.append(part)
        offsets[d + 1] = offsets[d] + len(part)
    return (np.concatenate(out) if out else runs[:0]), offsets
