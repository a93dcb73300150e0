"""Words and word windows of whole texts as 64-bit numbers, a batch at a time.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return.  Its number is a polynomial over its bytes modulo
2**64, taken from prefix sums, so a batch costs a few array passes whatever the
length of its words; windows are polynomials over word numbers.  Values are
scrambled last, so any of their bits may serve as a bucket.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BLOCK_BYTES = 1 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a byte array."""
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=solid[1:-1].view(bool))
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return scramble((total[ends] - total[starts]) * down[starts])


def word_numbers(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of the texts, and how many words each text has.

    Texts are joined by a blank into blocks of about a megabyte, so memory does
    not grow with the batch; one text is at most one block.
    """
    numbers: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < BLOCK_BYTES):
            size += len(texts[upto]) + 1
            upto += 1
        data = np.frombuffer(b" ".join(texts[at:upto]), np.uint8)
        if lower:
            data = lower_ascii(data)
        starts, ends = word_spans(data)
        limits = np.cumsum([len(t) + 1 for t in texts[at:upto]])
        counts[at:upto] = np.diff(np.searchsorted(starts, limits), prepend=0)
        numbers.append(_numbers(data, starts, ends))
        at = upto
    return (np.concatenate(numbers) if numbers else np.empty(0, np.uint64)), counts


def window_numbers(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The number of each run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(WINDOW_BASES[which])
    out = words[:n].copy()
    for k in range(1, width):
        out *= base
        out += words[k : k + n]
    return scramble(out)
