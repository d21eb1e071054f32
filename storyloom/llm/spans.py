"""Words and their hashes from whole batches of text at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from storyloom.llm.arrow import Ragged, gather

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd factors of the two rolling hashes, modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = 1 << 20
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for b in _BASES:
            up, down = np.full(n, b, np.uint64), np.full(n, pow(b, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _powers.append((np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """One or two 64-bit hashes of each data[start:end]; spans ascend and don't overlap. Works on about _STEP bytes at once."""
    out = [np.empty(len(starts), np.uint64) for _ in range(n)]
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _STEP, side="right")))
        hi = int(ends[to - 1])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        length = (e - s).astype(np.uint64)
        bytes_ = data[lo:hi].astype(np.uint64) + np.uint64(1)
        for h, (up, down) in zip(out, _power_tables(max(_STEP, hi - lo)), strict=False):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(bytes_ * up[: hi - lo], out=total[1:])
            h[at:to] = mix((total[e] - total[s]) * down[s] + length * np.uint64(_BASES[0]))
        at = to
    return out


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without white space) in the bytes, and the first word of each text and after the last."""
    full = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=full[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = full[:-1] & (~full[1:] | edge[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offsets)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[start:start + length] and b[start:start + length] hold the same bytes, for each span. Works on about _STEP bytes at once."""
    out, total, at = np.ones(len(length), bool), np.cumsum(length), 0
    while at < len(length):
        base = int(total[at] - length[at])
        to = max(at + 1, int(np.searchsorted(total, base + _STEP, side="right")))
        if to == at + 1:
            i, j, n = int(a_start[at]), int(b_start[at]), int(length[at])
            out[at] = np.array_equal(a[i : i + n], b[j : j + n])
        else:
            part = slice(at, to)
            other = np.flatnonzero(gather(a_start[part], length[part], a) != gather(b_start[part], length[part], b))
            out[at + np.searchsorted(total[part] - base, other, side="right")] = False
        at = to
    return out


class WordTable:
    """Ids of words that were seen before, found by a 64-bit hash; new ones are encoded by the function given.

    The table holds the words too, and a hash counts only where the bytes are equal: two
    words can be made to share any hash of this kind. A word whose hash another word has
    taken is found in a dictionary. Beyond ``most`` words or ``most_bytes`` the table starts anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000, most_bytes: int = 1 << 25) -> None:
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.hash, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.clashing: dict[bytes, int] = {}
        self.words, self.ids = Ragged(np.uint8), Ragged(np.uint32)

    def take(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each span, and all ids."""
        row = self._rows(data, starts, ends)  # first, as the table may start anew
        return self.ids.take(row)

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each span."""
        u, first, back = np.unique(hash_spans(data, starts, ends, 1)[0], return_index=True, return_inverse=True)
        if self.words.rows + len(u) > self.most or self.words.n > self.most_bytes:
            self.clear()
        at = np.searchsorted(self.hash, u)
        old = at < len(self.hash)
        old[old] = self.hash[at[old]] == u[old]
        row = np.full(len(u), -1, np.int64)
        row[old] = self.row[at[old]]
        if not old.all():
            new = np.flatnonzero(~old)
            row[new] = self._add(_cut(data, starts[first[new]], ends[first[new]]))
            where = at[new]
            self.hash, self.row = np.insert(self.hash, where, u[new]), np.insert(self.row, where, row[new])
        out, length = row[back], ends - starts
        same = self.words.length[out] == length
        same[same] = same_spans(data, starts[same], self.words.flat, self.words.start[out[same]], length[same])
        if not same.all():
            words = _cut(data, starts[~same], ends[~same])
            if new := [w for w in dict.fromkeys(words) if w not in self.clashing]:
                self.clashing.update(zip(new, self._add(new).tolist(), strict=True))
            out[~same] = [self.clashing[w] for w in words]
        return out

    def _add(self, words: list[bytes]) -> np.ndarray:
        n = self.ids.rows
        self.ids.extend(*self.encode(words))
        self.words.extend(np.fromiter(map(len, words), np.int64, len(words)), np.frombuffer(b"".join(words), np.uint8))
        return np.arange(n, n + len(words))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
