"""Vectorised words and shingles over Arrow strings: whole batches of UTF-8 bytes at once, no Python loop per word.

Words are maximal runs of bytes other than blank and \\x09-\\x0D, after A-Z are lower-cased. UTF-8 never uses those
byte values inside a longer code point, so words over bytes are words over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers = tuple(both)
    return _powers


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Words:
    """Words of the documents first..first+n-1 of a batch.

    hashes: one per word; bounds: n + 1 word indexes; starts, ends: byte places in `data`, which starts at byte `at`.
    """

    __slots__ = ("at", "bounds", "data", "ends", "first", "hashes", "offsets", "starts")

    def __init__(self, first: int, offsets: np.ndarray, data: np.ndarray, at: int):
        self.first, self.offsets, self.data, self.at = first, offsets, data, at
        full = ~_BLANK[data]
        n = len(data)
        head, tail = full.copy(), full.copy()
        head[1:] &= ~full[:-1]
        tail[:-1] &= ~full[1:]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        head[inner] |= full[inner]
        before = inner[inner > 0] - 1
        tail[before] |= full[before]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * power[:n], out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64) * _BASE)
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def word_chunks(column: pa.Array) -> Iterator[Words]:
    """The documents of a batch in chunks of about CHUNK bytes."""
    offsets, data = string_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(n, max(last, first + 1))
        a, b = offsets[first], offsets[last]
        yield Words(first, offsets[first : last + 1] - a, data[a:b], int(a))
        first = last


def grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on, over all places with q words left."""
    n = len(hashes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _PLACE[0]
    for j in range(1, q):
        total += hashes[j : j + n] * _PLACE[j]
    return mixed(total + _U(q))


def shingle_sets(words: Words, q: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct q-word shingles); a shorter document's whole sequence is its one shingle."""
    h, every = words.hashes, grams(words.hashes, q)
    for i in range(len(words)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= q:
            own = np.sort(every[a : b - q + 1])
            if len(own) > 1:
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif b > a:
            own = mixed((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a))
        else:
            own = h[:0]
        yield words.first + i, own
