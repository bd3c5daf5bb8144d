"""Latent-semantic vectors of texts: hashed byte n-grams, square-root weights, a truncated SVD."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .shingles import _word_hashes

BUCKETS, DIMS = 2048, 48
#: Weight of the term "a word that follows itself", one of the two that are no byte n-gram; the other is a word seen before in the text.
ECHO, AGAIN = 6.0, 1.0
#: Texts, and bytes of them, counted at a time; a longer text is taken whole.
_GROUP, _BYTES = 16, 1 << 18
_MIX = np.uint32(0x9E3779B1)


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends, raw


def bag(column: pa.Array, buckets: int = BUCKETS, words_of: Callable[[np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """(buckets: a power of two.) A row of unit length for each text (zero for null or empty ones): roots of counts of hashed byte pairs and
    triples, and of words that follow themselves or were in the text before.

    words_of is given the hashes of all words and the row of each, part by part; nulls have none.
    """
    ends, raw = _bounds(column)
    out = np.zeros((len(column), buckets + 2), np.float32)
    valid = np.asarray(column.is_valid()) if column.null_count else None
    i = 0
    while i < len(column):
        j = max(i + 1, min(len(column), i + _GROUP, int(np.searchsorted(ends, ends[i] + _BYTES, "right")) - 1))
        data = raw[ends[i] : ends[j]].astype(np.uint32)
        if len(data):
            owner = np.repeat(np.arange(j - i, dtype=np.int64) * buckets, np.diff(ends[i : j + 1]))
            total = np.zeros((j - i) * buckets)
            key = data
            for k in (2, 3):
                if len(data) >= k:
                    key = key[: len(data) - k + 1] << np.uint32(8) | data[k - 1 :]
                    slot = owner[: len(key)] + ((key + np.uint32(k)) * _MIX >> np.uint32(15) & np.uint32(buckets - 1))
                    total += np.bincount(slot, minlength=len(total))
                    # Those that reach into the next text are taken back.
                    across = (ends[i + 1 : j] - ends[i])[:, None] - np.arange(1, k)
                    across = np.unique(across[(across >= 0) & (across < len(key))])
                    total -= np.bincount(slot[across], minlength=len(total))
            out[i:j, :buckets] = np.sqrt(total).reshape(j - i, buckets)
            words, counts = _word_hashes(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            if len(words):
                of = np.repeat(np.arange(j - i), counts)
                if words_of is not None:
                    words_of(words, of + i)
                echo = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
                starts = np.concatenate(([0], np.cumsum(counts)))
                known = [n - len(np.unique(words[x : x + n])) if n > 1 else 0 for x, n in zip(starts, counts, strict=False)]
                out[i:j, buckets] = ECHO * np.sqrt(np.bincount(of[1:][echo], minlength=j - i))
                out[i:j, buckets + 1] = AGAIN * np.sqrt(known)
        i = j
    if valid is not None:
        out[~valid] = 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def word_slots(hashes: np.ndarray) -> np.ndarray:
    """One of 65,536 slots for each word."""
    return (hashes >> np.uint64(48)).astype(np.uint16)


def basis(bags: np.ndarray, dims: int = DIMS, weights: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors of the bags, (buckets x dims): the directions of the latent space."""
    rows = bags if weights is None else bags * np.sqrt(weights)[:, None]
    gram = (rows.T @ rows).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][: min(dims, len(values))]
    return np.ascontiguousarray(vectors[:, order], np.float32)


def project(bags: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space; zero where a text has none."""
    got = bags @ directions
    norm = np.sqrt((got * got).sum(1, keepdims=True))
    return np.divide(got, norm, out=got, where=norm > 1e-12)
