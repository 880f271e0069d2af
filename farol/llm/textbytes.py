"""Vectorised work on the UTF-8 bytes of many texts at a time: rolling hashes, words, shingles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to this many bytes; a longer text is taken alone, whole.
BLOCK_BYTES = 1 << 20


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and text offsets of consecutive rows; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _memo() -> dict:
    """Values kept by the process. They are kept in a module of their own: functions that travel by value have new globals in
    every task, and what those hold stays in memory until the garbage collector happens to look at them."""
    return vars(sys.modules.setdefault("farol_memo", ModuleType("farol_memo")))


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size > BLOCK_BYTES:
        return _powers_of(seed, size)
    memo = _memo()
    if f"powers {seed} {size}" not in memo:
        memo[f"powers {seed} {size}"] = _powers_of(seed, size)
    return memo[f"powers {seed} {size}"]


def _powers_of(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(np.random.default_rng(seed).integers(1 << 61)) * 8 + 5
    back = pow(base, -1, 1 << 64)
    up, down = np.full(size, base, np.uint64), np.full(size, back, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Rolling:
    """64-bit fingerprints of any substring after one pass: a polynomial over random byte values, modulo 2^64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        up, self.down = _powers(seed, size)
        table = np.random.default_rng(seed + 1000).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:len(data)], out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        """Fingerprint of the q bytes at every place."""
        if len(self.sums) <= q:
            return np.zeros(0, np.uint64)
        return mix((self.sums[q:] - self.sums[:-q]) * self.down[:len(self.sums) - q])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that are no separators; none crosses texts."""
    inside = ~separator[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and fingerprint of the distinct word shingles, sorted by both, and the words of each text.

    A-Z count as a-z. A text with fewer words has its whole sequence as its only shingle.
    """
    starts, ends, text = words(data, offsets)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    word = Rolling(LOWER[data]).ranges(starts, ends)
    firsts = np.cumsum(counts) - counts
    owners, values = [], []
    for n in range(1, size + 1):
        at = firsts[counts == n] if n < size else np.flatnonzero(text[:len(text) - size + 1] == text[size - 1:]) if len(text) >= size else firsts[:0]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _STEP + word[at + k]
        owners.append(text[at])
        values.append(mix(h))
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new], counts


def as_long(h: np.ndarray) -> pa.Array:
    """Fingerprints as Spark's signed long."""
    return pa.array(h.view(np.int64))
