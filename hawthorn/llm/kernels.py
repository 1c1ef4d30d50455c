"""Numpy kernels over the bytes of many texts at once: words, word hashes, shingle sets, minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER_BYTE = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that a kernel handles at a time: its arrays of eight bytes for each stay near the processor's cache.
CHUNK = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 1024), base % 2**64, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
        if len(have) > 16 * CHUNK:  # a single huge text: don't keep what it needed
            _powers.pop(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows holding about limit bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lowered."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(_INV, len(data))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; a shorter text is one shingle as a whole."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return np.unique(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column."""
    for _, data, offsets in text_chunks(column):
        starts, ends, first = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            yield shingles(hashes[first[i] : first[i + 1]], k)


class Minima:
    """Minima of many universal hash functions a*x+b modulo 2**32 over a set of 64-bit hashes."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    def __call__(self, items: np.ndarray, step: int = 2048) -> np.ndarray:
        x = (items >> _U(32)).astype(np.uint32)
        out = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for i in range(0, len(x), step):
            h = self.a * x[None, i : i + step]
            h += self.b
            np.minimum(out, h.min(axis=1), out=out)
        return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
    m = minima[: bands * rows].astype(np.uint64).reshape(bands, rows)
    for i in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + m[:, i])
    return out
