"""Vectorised word and hash kernels over Arrow string buffers.

A slice of texts is one UTF-8 byte array with document offsets.  Words are
maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; a word never
crosses a document.  A word's 64-bit key is a polynomial in an odd base over
randomised byte values, read off a prefix sum modulo 2**64, so that hashing a
slice costs a few array passes however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space, controls and ASCII punctuation, for words of letters and digits.
PUNCTUATION = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_KEY_LOWER = _BYTE_KEY[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 1 mod 4: full period
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text handled at once; one longer document makes a slice by itself.
SLICE_BYTES = 2 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Texts:
    """A slice of documents: bytes, offsets and lazily the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def split(self, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words (runs of bytes outside ``gap``), and per document the first word's number."""
        size = len(self.data)
        if not size:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(self.n + 1, np.int64)
        word = ~gap[self.data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        end = word.copy()
        end[:-1] &= ~word[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def prefix(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums for hashes of byte ranges, and the inverse powers they need."""
        power, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_BYTE_KEY_LOWER if lower else _BYTE_KEY)[self.data] * power[:-1], out=sums[1:])
        return sums, inverse

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit keys of the byte ranges."""
        sums, inverse = self.prefix(lower)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of up to ``limit`` bytes: first row, end row, texts."""
    if not len(column):
        return
    data, offsets = string_buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``first[i]:first[i+1]``, empty ones 0."""
    if values.dtype.kind == "f":  # differences of long running sums would lose digits
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return np.bincount(rows, values, len(first) - 1).astype(values.dtype)  # without any value it counts in integers
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


class HashIndex:
    """Positions of distinct 64-bit keys: an open-addressing table, used in array passes."""

    def __init__(self, keys: np.ndarray):
        self.size = 0
        self._reserve(len(keys))
        self.add(keys)

    def _reserve(self, n: int) -> None:
        self.bits = max(4, int(2 * max(n, 1)).bit_length() + 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.where = np.full(1 << self.bits, -1, np.int32)

    def add(self, keys: np.ndarray) -> None:
        """Give new keys the next positions."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.where >= 0
            old = np.empty(self.size, np.uint64)
            old[self.where[held]] = self.keys[held]
            self._reserve(self.size + len(keys))
            self.size = 0
            self.add(old)
        left = np.arange(len(keys), dtype=np.int64)
        slot = self._slot(keys)
        while len(left):
            free = self.where[slot] < 0
            self.where[slot[free]] = left[free] + self.size  # of several, one stays
            self.keys[slot[free]] = keys[left[free]]
            out = self.where[slot] != left + self.size
            left, slot = left[out], (slot[out] + 1) & (len(self.keys) - 1)
        self.size += len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = self.where[slot]
            hit = (self.keys[slot] == keys[left]) & (at >= 0)
            out[left[hit]] = at[hit]
            on = ~hit & (at >= 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class Tally:
    """Counts of 64-bit keys, merged before they are handed on."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= self.limit

    def take(self) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in self.parts)])
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(sums)], ["key", "n"])
