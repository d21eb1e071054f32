"""Breadth-first walks over an undirected graph of numbered nodes, from many sources at once: a bit for each source and node."""

from __future__ import annotations

import numpy as np

#: Rows whose neighbours are gathered at once, and the degree from which a node is gathered by itself.
ROWS, ALONE = 1 << 11, 1 << 8
#: Degrees are padded to these, by repeating a neighbour.
WIDTHS = np.unique(np.ceil(1.125 ** np.arange(1, 49)).astype(np.int64))


def neighbours(a: np.ndarray, b: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's neighbours begin, and the neighbours, of undirected links of which each is given once."""
    m = len(a)
    link = np.empty(2 * m, np.int64)
    link[:m], link[m:] = a, b
    first = np.concatenate([[0], np.cumsum(np.bincount(link, minlength=nodes))])
    link <<= 32
    link[:m] |= b
    link[m:] |= a
    link.sort()
    return first, link.astype(np.int32)  # the lower half


def near_together(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nodes breadth first, each level in order of the nodes it was reached from: nodes near each other have numbers near each other."""
    seen, out = np.zeros(len(first) - 1, bool), []
    for root in range(len(seen)):
        if seen[root]:
            continue
        level = np.array([root], np.int64)
        while len(level):
            seen[level] = True
            out.append(level)
            n = first[level + 1] - first[level]
            new = to[np.arange(n.sum()) + np.repeat(first[level] - (np.cumsum(n) - n), n)]
            new, at = np.unique(new[~seen[new]], return_index=True)
            level = new[np.argsort(at)].astype(np.int64)
        if len(out) and sum(map(len, out)) == len(seen):
            break
    return np.concatenate(out) if out else np.empty(0, np.int64)


def renumbered(first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = near_together(first, to)
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    n = (first[1:] - first[:-1])[order]
    begin = np.cumsum(n) - n
    out = np.empty(len(to), np.int32)
    for lo in range(0, len(order), 1 << 18):  # in parts, as the positions take eight bytes each
        k = order[lo : lo + (1 << 18)]
        m = n[lo : lo + len(k)]
        here = np.arange(m.sum()) + np.repeat(first[k] - (np.cumsum(m) - m), m)
        out[begin[lo] : begin[lo] + len(here)] = number[to[here]]
    return np.append(begin, len(to)), out


class Walker:
    """Nodes are grouped by degree, so that the neighbours of a group are a table with a row for each of its nodes."""

    def __init__(self, first: np.ndarray, to: np.ndarray) -> None:
        self.nodes = len(first) - 1
        degree = first[1:] - first[:-1]
        width = np.append(WIDTHS[WIDTHS < ALONE], ALONE)
        kind = np.searchsorted(width, degree)
        self.alone = [(int(v), to[first[v] : first[v + 1]]) for v in np.flatnonzero(degree > ALONE)]
        self.groups = []
        for k, w in enumerate(width):
            if len(v := np.flatnonzero((kind == k) & (degree > 0))):
                at = first[v][:, None] + np.minimum(np.arange(w), degree[v][:, None] - 1)
                self.groups.append((v, to[at]))

    def walk(self, lo: int, hi: int) -> tuple[int, int, int]:
        """Sum of the distances from the nodes lo to hi - 1 to all that they reach, number of these pairs, and the largest distance.

        A step takes the nodes next to one that was reached in the last, but for those that all sources have reached.
        """
        words = max(1, -(-(hi - lo) // 64))
        far = np.zeros((self.nodes, words), np.uint64)
        k = np.arange(hi - lo)
        far[lo + k, k >> 6] = np.uint64(1) << (k & 63).astype(np.uint64)
        seen, every = far.copy(), np.bitwise_or.reduce(far[lo:hi], axis=0) if hi > lo else np.zeros(words, np.uint64)
        done = (seen == every).all(axis=1)
        reached = np.zeros(self.nodes, bool)
        reached[lo:hi] = True
        total = pairs = most = step = 0
        buffer = np.empty((ROWS, words), np.uint64)
        while reached.any():
            step += 1
            near = np.zeros(self.nodes, bool)
            for v, to in self.groups:
                near[to[reached[v]]] = True
            for v, to in self.alone:
                if reached[v]:
                    near[to] = True
            near &= ~done
            found = []
            for v, to in self.groups:
                at = np.flatnonzero(near[v])
                for i in range(0, len(at), ROWS):
                    rows = at[i : i + ROWS]
                    by = np.ascontiguousarray(to[rows].T)
                    got, more = far.take(by[0], axis=0, mode="clip"), buffer[: len(rows)]
                    for column in by[1:]:
                        far.take(column, axis=0, out=more, mode="clip")
                        np.bitwise_or(got, more, out=got)
                    found.append((v[rows], got))
            for v, to in self.alone:
                if near[v]:
                    got = np.zeros(words, np.uint64)
                    for i in range(0, len(to), ROWS):
                        got |= np.bitwise_or.reduce(far[to[i : i + ROWS]], axis=0)
                    found.append((np.array([v]), got[None]))
            far[reached] = 0
            reached[:] = False
            count = 0
            for v, got in found:
                before = seen[v]
                got &= ~before
                n = np.bitwise_count(got).sum(axis=1)
                v, got, before = (x[n > 0] for x in (v, got, before))
                count += int(n.sum())
                before |= got
                far[v], seen[v], reached[v] = got, before, True
                done[v] = (before == every).all(axis=1)
            total, pairs, most = total + count * step, pairs + count, step if count else most
        return total, pairs, most
