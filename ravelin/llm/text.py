"""Vectorised text helpers that the Arrow functions of this subpackage share.

A *word* is a maximal run of ASCII letters, digits, underscores and any
non-ASCII characters. Case is folded for ASCII and for the Latin-1 capitals
(À to Þ), both without a change of length, so that byte positions in the
folded text are positions in the text itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step handles, so that its arrays stay in the cache; a longer document is one step by itself.
STEP_BYTES = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[95] = _IS_WORD[128:] = True
_BASE = U64(0x9E3779B97F4A7C15)

#: The same fold as two strings, for translate() in SQL.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
FOLD_TO = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7)
#: A word of the folded text, for RE2.
WORD_RE2 = r"[0-9a-z_\x{80}-\x{10FFFF}]+"


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def lean(function: Callable) -> Callable:
    """An Arrow function that gives freed memory back after each batch: a worker outlives its task, and what it keeps is missing for the next stage."""

    @wraps(function)
    def whole(*columns: pa.Array) -> pa.Array:
        made = function(*columns)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)
        return made

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capitals in lower case."""
    low = _FOLD[data]
    if len(low) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    return low


def hashes_of(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of byte strings that follow each other in ``data``, none of them empty."""
    if not len(at):
        return np.zeros(0, U64)
    within = np.arange(len(data), dtype=np.int64) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max()), _BASE, U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)
    values = (data.astype(U64) + U64(1)) * powers[within]
    return mix(np.add.reduceat(values, at) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of some rows: ``hashes``, byte ``starts`` and ``ends``, and ``rows``, the word offsets of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = fold(data)
        word = _IS_WORD[low]
        first = np.zeros(len(low) + 1, dtype=bool)
        first[offsets[:-1]] = True
        before = np.empty(len(low), dtype=bool)
        if len(low):
            before[0], before[1:] = False, word[:-1]
        begins = word & (~before | first[:-1])
        self.starts = np.flatnonzero(begins)
        last = word.copy()
        if len(low) > 1:
            last[:-1] &= ~word[1:] | begins[1:]
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.bytes = low[word]
        lengths = self.ends - self.starts
        self.lengths = lengths
        self.at = np.cumsum(lengths) - lengths
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        return hashes_of(self.bytes, self.at, self.lengths)

    def array(self) -> pa.Array:
        """The words as a binary Arrow array."""
        offsets = np.concatenate([self.at, [len(self.bytes)]]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.bytes))])


class HashTable:
    """Places of distinct 64-bit hashes in flat arrays, by open addressing; ``find`` gives -1 for others. At most half of the slots are in use."""

    def __init__(self, hashes: np.ndarray):
        self.mask = (1 << max(1, 2 * len(hashes) - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, U64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        todo = np.arange(len(hashes))
        slot = (hashes & U64(self.mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.values[slot[todo]] < 0)
            # of several for one slot, the last written stays
            self.values[slot[todo[free]]] = todo[free]
            todo = todo[self.values[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        there = self.values >= 0
        self.keys[there] = hashes[self.values[there]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & U64(self.mask)).astype(np.int64)
        out = self.values[slot].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.values[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != hashes[todo])]
        return out


def words_of(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for the whole column, step by step."""
    data, offsets = raw(column)
    for lo, hi in steps(offsets):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by doubling; n - k + 1 of them, regardless of rows."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    part, size, done, out = hashes, 1, 0, None
    power = _BASE
    weight = U64(1)
    left = k
    while left:
        if left & 1:
            piece = part[done : done + n - k + 1] * weight
            out = piece if out is None else out + piece
            done += size
            weight = U64(int(weight) * int(power) % (1 << 64))
        left >>= 1
        if left:
            part = part[:-size] + part[size:] * power
            power = U64(int(power) ** 2 % (1 << 64))
            size *= 2
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling; n - w + 1 of them."""
    if len(values) < w:
        return values[:0]
    part, size = values, 1
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return part if size == w else np.minimum(part[: len(values) - w + 1], part[w - size : len(values) - size + 1])


def lists(values: pa.Array, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A list column of ``values``; rows where ``valid`` is False are null."""
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)
