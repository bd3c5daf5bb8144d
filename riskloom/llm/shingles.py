"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0
_PLACE = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time; a longer text is taken whole.
_SLICE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z, and the number of words in each document."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    first = bounds[:-1][bounds[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    sums = np.add.reduceat(_BYTE[data] * _PLACE[place & 0xFFFF], starts)
    return mix(sums), counts


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    words, counts = _word_hashes(data, bounds)
    at = np.concatenate(([0], np.cumsum(counts)))
    runs = np.zeros(0, np.uint64)
    if len(words) >= k:
        runs = sum((words[j : len(words) - k + 1 + j] * _WORD[j] for j in range(1, k)), words[: len(words) - k + 1] * _WORD[0])
        runs = mix(runs)
    for d, n in enumerate(counts):
        if n >= k:
            yield np.unique(runs[at[d] : at[d] + n - k + 1])
        elif n:
            short = words[at[d] : at[d] + n]
            yield mix((short * _WORD[:n]).sum(dtype=np.uint64, keepdims=True) + _WORD[k : k + 1] * np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words: one for the whole sequence; none: empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SLICE, "right")) - 1)
        bounds = ends[i : j + 1] - ends[i]
        for d, got in enumerate(_sets(raw[ends[i] : ends[j]], bounds, k)):
            yield got if not column.null_count or valid[i + d] else got[:0]
        i = j
