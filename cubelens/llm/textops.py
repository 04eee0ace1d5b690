"""Vectorised text work on UTF-8 bytes, for the operators that run in Python on Arrow batches."""

from __future__ import annotations

import numpy as np

#: Fixed odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values, another one for each salt."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 1 << 23:  # longer ones are made anew, not held
            _POWERS[name] = have
    return have[:n]


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ALNUM, ideographs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words of all texts, and for each text the number of words before it.

    A word is a longest run of bytes that ``inside`` has; none crosses from one text to the next. With ``ideographs``
    each character from U+3000 to U+9FFF, of scripts that are written without spaces, is a word of its own.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[raw]
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    if ideographs:
        lead = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
        opens[lead] = True
        closes[np.minimum(lead + 2, n - 1)] = True
        closes[lead[lead > 0] - 1] |= mask[lead[lead > 0] - 1]
        behind = lead[lead + 3 < n] + 3
        opens[behind] |= mask[behind]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    opens[edge] |= mask[edge]
    closes[edge - 1] |= mask[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z as a-z, alike wherever the word stands."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers("base", BASE, n), out=sums[1:])
    return mix64((sums[end] - sums[start]) * _powers("inverse", INVERSE, n)[start])


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, order told; len - k + 1 of them, across text limits too."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + word[i : i + n]
    return mix64(out)
