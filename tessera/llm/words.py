"""Words of texts as 64-bit numbers, computed for many texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Its number is a polynomial over a table
of random values, taken modulo 2**64 and mixed; equal words have equal numbers wherever they stand,
and 64 bits make equal numbers of different words improbable.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes whose powers are held in tables; longer stretches are cut between words.
_STRETCH = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words: white space, or every ASCII byte that is no letter and no digit.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NO_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that lets every bit depend on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = powers(_BASE, _STRETCH), powers(_BASE_INVERSE, _STRETCH)


@dataclass
class Words:
    """The words of a batch of texts.

    ``data``: the bytes of all texts; ``starts``, ``ends``: of each word in ``data``; ``first``: the
    number of the first word of each text, and of a text after the last; ``text_at``: where each text
    begins in ``data``, and the end.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def place(self) -> np.ndarray:
        """The place of each word in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins, and the end; null counts as empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def split(column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACES) -> Words:
    """The words of the strings of a column; null counts as empty. ``lower``: A-Z as a-z."""
    data, at = bytes_of(column)
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(at), np.int64), at)
    if lower:
        data = _LOWER[data]
    gap = gaps[data]
    before = np.r_[True, gap[:-1]]
    before[at[:-1][at[:-1] < len(data)]] = True
    after = np.r_[gap[1:], True] if len(data) else gap
    ends_at = at[1:][at[1:] > 0] - 1
    after[ends_at] = True
    inside = ~gap
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), at)


def numbers(words: Words) -> np.ndarray:
    """The 64-bit number of each word."""
    out = np.empty(len(words.starts), np.uint64)
    starts, ends, i = words.starts, words.ends, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STRETCH, "right")))
        low, high = starts[i], ends[j - 1]
        n = int(high - low)
        power, inverse = (_POWER, _INVERSE) if n <= _STRETCH else (powers(_BASE, n), powers(_BASE_INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[words.data[low:high]] * power[:n], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out)


_STEP = np.uint64(0xD1342543DE82EF95)


def grams(number: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each run of ``n`` words within a text, and the number of its first word."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    at = np.flatnonzero(words.place() + n <= np.repeat(words.counts(), words.counts()))
    if len(at) == 0:
        return np.zeros(0, np.uint64), at
    if n <= 4:
        total = number[at]
        for k in range(1, n):
            total = total * _STEP + number[at + k]
        return mix(total + np.uint64(n)), at
    power, inverse = powers(_STEP, len(number)), powers(np.uint64(pow(int(_STEP), -1, 2**64)), len(number))
    sums = np.zeros(len(number) + 1, np.uint64)
    np.cumsum(number * power, out=sums[1:])
    return mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)), at
