"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

All suffixes of one bucket that are known at a time induce their predecessors in one
step, so that a pass takes a few steps for each symbol of the alphabet instead of one for each
suffix. Leftmost-smaller substrings are sorted and named by a first pass; where names repeat,
the string of names is sorted in the same way, recursively, as long as there are no more than ``MOST_NAMES`` of them. Where there are more, steps
by bucket would be too many and most names are different anyway: there a few rounds of prefix doubling sort the string. A second pass induces the array from it.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, a unique least symbol, counts as such."""
    n = len(t)
    change = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
    small = np.append(t[:-1] < t[1:], True)
    return small[change[np.searchsorted(change, np.arange(n))]]


class _Inducer:
    def __init__(self, t: np.ndarray, k: int, small: np.ndarray) -> None:
        self.t, self.k, self.small = t, k, small
        self.size = np.bincount(t, minlength=k)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def _push(self, items: np.ndarray, small: bool, sa: np.ndarray, edge: np.ndarray) -> None:
        p = items - 1
        p = p[p >= 0]
        p = p[self.small[p] == small]
        if not len(p):
            return
        c = self.t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        kinds, count = c[begin], np.diff(np.append(begin, len(c)))
        place = np.arange(len(c)) - np.repeat(begin, count)
        if small:
            sa[np.repeat(edge[kinds], count) - 1 - place] = p
            edge[kinds] -= count
        else:
            sa[np.repeat(edge[kinds], count) + place] = p
            edge[kinds] += count

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, from the leftmost-smaller ones in order."""
        sa = np.full(len(self.t), -1, np.int64)
        c = self.t[lms]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=self.k)
        place = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
        sa[np.repeat(self.end - count, count) + place] = lms[order]
        head = self.start.copy()
        for b in np.flatnonzero(self.size).tolist():
            lo = self.start[b]
            while lo < head[b]:
                items, lo = sa[lo : head[b]].copy(), head[b]
                self._push(items, False, sa, head)
            if count[b]:
                self._push(sa[self.end[b] - count[b] : self.end[b]].copy(), False, sa, head)
        tail = self.end.copy()
        for b in np.flatnonzero(self.size).tolist()[::-1]:
            hi = self.end[b]
            while tail[b] < hi:
                items, hi = sa[tail[b] : hi][::-1].copy(), tail[b]
                self._push(items, True, sa, tail)
            if head[b] > self.start[b]:
                self._push(sa[self.start[b] : head[b]][::-1].copy(), True, sa, tail)
        sa[0] = len(self.t) - 1
        return sa


#: Different names up to which their string is sorted recursively.
MOST_NAMES = 1 << 12


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by prefix doubling."""
    rank, step, m = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(m, np.int64)
        after[: m - step] = rank[step:] + 1 if step < m else 0
        key = rank * (m + 2) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(m, np.int64)
        rank[order] = new
        if new[-1] == m - 1:
            return order
        step *= 2


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, the last of which is the least and the only one of its kind."""
    k = int(names.max()) + 1
    return suffix_array(names, k) if k <= MOST_NAMES else _doubled(names)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Of symbols below k; the last must be 0 and the only one."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    ind = _Inducer(t, k, small)
    sa = ind.induce(lms)
    by_substring = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = length[a] == length[b]
    live, at = np.flatnonzero(same), 0
    while len(live):  # equal so far
        live = live[at < length[a[live]]]
        differs = t[a[live] + at] != t[b[live] + at]
        same[live[differs]] = False
        live, at = live[~differs], at + 1
    name = np.zeros(n, np.int64)
    name[by_substring] = np.concatenate([[0], np.cumsum(~same)])
    if not same.any():
        return ind.induce(by_substring)
    return ind.induce(lms[_sorted_names(name[lms])])


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text position: length of the prefix shared with the suffix before it in the array, and that suffix (-1: none).

    Where the symbols before the two are equal, the length is that of the position before less one; only the other positions are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (before[1:] < 1) | (t[:-1] != t[before[1:] - 1])
    start = np.flatnonzero(own)
    w = np.zeros(n + 4, np.uint64)
    w[:n] = t
    w = w[:n] | w[1 : n + 1] << np.uint64(16) | w[2 : n + 2] << np.uint64(32) | w[3 : n + 3] << np.uint64(48)
    length = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    a, b = start[live], before[start[live]]
    while len(live):
        x = w[a] ^ w[b]
        rest = x != 0
        y = x[rest]
        length[live[rest]] += ((y & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((y & np.uint64(0xFFFFFFFF)) == 0) + ((y & np.uint64(0xFFFFFFFFFFFF)) == 0)
        live, a, b = live[~rest], a[~rest] + 4, b[~rest] + 4
        length[live] += 4
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
    of = np.cumsum(own) - 1
    return np.maximum(length[of] - (np.arange(n) - start[of]), 0), before
