"""Words and hashes of whole Arrow batches at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
CODES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null reads as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if column.null_count:
        column = column.fill_null(
            "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        )
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(wordy: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets."""
    n = len(wordy)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = wordy.copy(), wordy.copy()
    start[1:] &= ~wordy[:-1]
    end[:-1] &= ~wordy[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = wordy[cut]
    end[cut - 1] = wordy[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated start .. start + len - 1."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lens)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each non-empty byte span: a polynomial over random byte codes, mixed with the length."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    at = ranges(starts, lens)
    power = np.cumprod(np.full(int(lens.max()), BASES[seed], np.uint64))
    codes = CODES[seed][data[at]] * power[at - np.repeat(starts, lens)]
    return mix(np.add.reduceat(codes, first) ^ (lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def words(
    data: np.ndarray, off: np.ndarray, lower: bool, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace-separated words of every text: starts, ends, hashes, number of words before each text (n + 1)."""
    starts, ends = spans(~SPACE[data], off)
    return starts, ends, hash_spans(LOWER[data] if lower else data, starts, ends, seed), np.searchsorted(starts, off)


def shingles(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted within it, and the n + 1 bounds.

    A text of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = ranges(bounds[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    have = np.repeat(np.minimum(n, k), count)
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    for j in range(k):
        value = mix(
            value * np.uint64(0x9FB21C651E98DF25) + np.where(
                j < have, padded[at + j] + np.uint64(2 * j + 1), np.uint64(0)
            ),
        )
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(
        values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False), pa.int64()
    )
