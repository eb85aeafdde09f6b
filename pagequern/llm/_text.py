"""Words, shingles and byte strings of Arrow text columns as numpy arrays.

Texts of a batch lie one after another in one byte buffer, and all steps work on that buffer.
Hashes are 64 bits: a polynomial over bytes or words, then a finalizer that spreads its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; one longer text makes a chunk of its own.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows and the end within them) of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which hashes of any byte range follow, see range_hash."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes[start:end], alike wherever the bytes stand."""
    return mix64((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word and, for each text, the index of its first word, with the end at last."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = range_hash(byte_sums(_LOWER[data] if lower else data), start, end)
    return start, end, hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row; those that run over a text's end are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + hashes[j : j + n]
    return mix64(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words, one hash of all of them."""
    _, _, hashes, first = words(data, offsets)
    every = shingles(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            total = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                total = mix64(total * _BASE + h)
            yield total
        else:
            yield np.zeros(0, np.uint64)


def near_copies(texts: pa.Array) -> list[bool]:
    """Whether a text shares one of eight min-hashes with an earlier one: copies, near ones too, would make their own words look typical."""
    seen: set[tuple[int, int]] = set()
    out = []
    turns = mix64(np.arange(1, 9, dtype=np.uint64))[:, None]
    for _, _, data, offsets in text_chunks(texts):
        for found in shingle_sets(data, offsets, 5):
            keys = set(enumerate(mix64(found ^ turns).min(axis=1).tolist())) if len(found) else {(8, 0)}
            out.append(not keys.isdisjoint(seen))
            seen |= keys
    return out
