"""Draws with replacement by MD5 counters in NumPy: draw i of replicate b is MD5(seed|b|i), the same on any engine.

Draws don't depend on the key, so that a task makes them once for all keys that it holds.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

TAIL = 5  # digits that vary within one run of NumPy calls: arrays of 400 KB
_TURNS = np.repeat([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], 4, axis=0).reshape(64).tolist()
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


@cache
def _digits(width: int) -> list[np.ndarray]:
    """ASCII of each of the ``width`` digits of 0, 1, 2, ..., with leading zeros."""
    n = np.arange(10**width, dtype=np.uint32)
    return [n // 10 ** (width - 1 - k) % 10 + np.uint32(48) for k in range(width)]


def _md5_head(prefix: bytes, tail: list[np.ndarray]) -> np.ndarray:
    """The first 48 bits of the MD5 of ``prefix`` and the digits of each row: one block, so 55 bytes at most."""
    n, size = len(tail[0]), len(prefix) + len(tail)
    if size > 55:
        raise ValueError("the text of a draw is too long")
    fixed = bytearray(prefix + b"\0" * len(tail) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    words = [int.from_bytes(fixed[k : k + 4], "little") for k in range(0, 64, 4)]
    moved: dict[int, np.ndarray] = {}
    for k, digit in enumerate(tail, len(prefix)):
        moved[k // 4] = moved.get(k // 4, np.uint32(0)) + (digit << np.uint32(8 * (k % 4)))
    a, b, c, d = (np.full(n, x, np.uint32) for x in _FIRST)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, np.uint32((_SINES[i] + words[at]) & 0xFFFFFFFF), out=f)
        if at in moved:
            np.add(f, moved[at], out=f)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t), np.left_shift(f, np.uint32(_TURNS[i]), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a  # the array of a is written next
    head, more = a + np.uint32(_FIRST[0]), b + np.uint32(_FIRST[1])
    return (head.byteswap().astype(np.int64) << 16) | more.astype(np.uint16).byteswap()


def draws(seed: int, replicate: int, low: int, high: int) -> np.ndarray:
    """Draws ``low`` to ``high`` of a replicate, as numbers of 48 bits."""
    out, at = np.empty(high - low, np.int64), low
    while at < high:
        # numbers of one length that agree in all but their last digits
        width = min(len(str(at)), TAIL)
        base = at - at % 10**width
        end = min(high, base + 10**width)
        head = f"{seed}|{replicate}|{base // 10**width or ''}".encode()
        out[at - low : end - low] = _md5_head(head, [x[at - base : end - base] for x in _digits(width)])
        at = end
    return out
