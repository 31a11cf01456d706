"""Sorting suffixes by hash comparisons: polynomial prefix hashes and binary search.

The common extension of two suffixes is found by binary search over its length,
comparing substring hashes taken from prefix sums, so a comparison costs the logarithm
of the length. A bottom-up mergesort places each element by binary search in its
sibling run, whole levels at a time in numpy. The extensions of neighbours in the
final order are verified byte by byte, so a hash collision can never join strings
that differ.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Powers that a worker keeps between calls, at most; longer texts compute their own.
KEPT_POWERS = 5 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (BASE, INVERSE):
        x = np.full(max(n, min(KEPT_POWERS, -(-n // (1 << 18)) << 18)), base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n <= KEPT_POWERS:
        _powers = out
    return out


class Prefix:
    """Hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common extensions of the suffixes at a and b, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same & open_, mid, low), np.where(same | ~open_, high, mid - 1)
        return low

    def less(self, a, b, la, lb, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a (of length la) stands before b; equal ones if ``or_equal``."""
        most = np.minimum(la, lb)
        n = self.common(a, b, most)
        inside = n < most
        at = np.minimum(n, np.maximum(most - 1, 0))
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + at, last)], self.data[np.minimum(b + at, last)]
        return np.where(inside, x < y, (la < lb) | ((la == lb) & or_equal))


def order(prefix: Prefix, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes by (group, text); ``group`` ascends already."""
    n = len(start)
    now = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while width < (size.max() if n else 0):
        p = np.flatnonzero(end - begin > width)  # places in groups that still merge
        q = p - begin[p]
        run = q // width
        low = begin[p] + (run ^ 1) * width
        high = np.minimum(low + width, end[p])
        has = low < end[p]
        p, q, run, low, high = p[has], q[has], run[has], low[has], high[has]
        base, me, odd = low.copy(), now[p], run % 2 == 1
        while (open_ := np.flatnonzero(low < high)).size:  # how many of the sibling run stand before
            mid = (low[open_] + high[open_]) >> 1
            other = now[mid]
            before = prefix.less(start[other], start[me[open_]], length[other], length[me[open_]], odd[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = begin[p] + (run // 2) * 2 * width + (q - run * width) + (low - base)
        new = now.copy()
        new[to] = me
        now = new
        width *= 2
    return now


def neighbours(prefix: Prefix, start: np.ndarray, length: np.ndarray, group: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Verified common extension of each element of the order with the one before it.

    -1 at the first of a group.
    """
    out = np.full(len(now), -1, np.int64)
    if len(now) < 2:
        return out
    b, a = now[1:], now[:-1]
    same = group[a] == group[b]
    a, b = a[same], b[same]
    n = prefix.common(start[a], start[b], np.minimum(length[a], length[b]))
    for s in range(0, len(a), 4096):
        x, y, m = start[a[s : s + 4096]], start[b[s : s + 4096]], n[s : s + 4096]
        step = np.arange(int(m.max(initial=0)))
        last = len(prefix.data) - 1
        differ = (prefix.data[np.minimum(x[:, None] + step, last)] != prefix.data[np.minimum(y[:, None] + step, last)]) & (step < m[:, None])
        wrong = differ.any(axis=1)
        if wrong.any():
            m[wrong] = differ[wrong].argmax(axis=1)
    out[1:][same] = n
    return out
