"""A lexicon as a minimal acyclic transducer: words in, id lists out.

States with equal futures are shared, so common suffixes are stored once. Each arc
carries how many words come before those below it; summed along a word these give
the word's number, and so its ids. The file is a plain layout of arrays that workers
memory-map; look-ups take one step of all words at a time.
"""

from __future__ import annotations

import json

import numpy as np

_PARTS = ("keys", "target", "skip", "final", "start", "ids")


def compile_lexicon(words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file for the given distinct words, whose ids lie one after the other."""
    order = sorted(range(len(words)), key=words.__getitem__)
    begin = np.cumsum(lengths) - lengths
    register: dict[tuple, int] = {}
    arcs_of: list[tuple[tuple[int, int], ...]] = []
    final_of: list[bool] = []
    path: list[tuple[list[tuple[int, int]], list[bool]]] = [([], [False])]  # open states along the last word

    def close(depth: int, last: bytes) -> None:
        """Gives the open states below depth their places, equal ones the same."""
        while len(path) - 1 > depth:
            arcs, end = path.pop()
            key = (end[0], tuple(arcs))
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(key[1])
                final_of.append(end[0])
            path[-1][0].append((last[len(path) - 1], register[key]))

    last = b""
    for i in order:
        w = words[i]
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same, last)
        path.extend(([], [False]) for _ in range(len(w) - same))
        path[-1][1][0] = True
        last = w
    close(0, last)
    arcs, end = path[0]
    arcs_of.append(tuple(arcs))
    final_of.append(end[0])
    below: list[int] = []  # words from each state; children come first
    keys, target, skip = [], [], []
    for s, arcs in enumerate(arcs_of):
        n = int(final_of[s])
        for label, to in arcs:
            keys.append(s << 8 | label)
            target.append(to)
            skip.append(n)
            n += below[to]
        below.append(n)
    parts = {
        "keys": np.array(keys, np.int64),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array(final_of, np.uint8),
        "start": np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64) if len(words) else np.zeros(1, np.int64),
        "ids": np.concatenate([ids[begin[i] : begin[i] + lengths[i]] for i in order]).astype(np.uint32) if len(words) else np.empty(0, np.uint32),
    }
    head, at, body = {}, 0, b""
    for name in _PARTS:
        raw = parts[name].tobytes()
        head[name] = [str(parts[name].dtype), at, len(parts[name])]
        body += raw + b"\0" * (-len(raw) % 8)
        at = len(body)
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    return len(top).to_bytes(8, "little") + top + body


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        for name, (kind, at, count) in json.loads(raw[8 : 8 + n].tobytes()).items():
            size = np.dtype(kind).itemsize * count
            setattr(self, name, raw[8 + n + at : 8 + n + at + size].view(kind))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it isn't in the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state, number, live = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        step = 0
        while len(live):
            ends = length[live] == step
            if ends.any():
                at = live[ends]
                at = at[self.final[state[at]] > 0]
                out[at] = number[at]
                live = live[~ends]
            key = state[live] << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            live, arc = live[there], arc[there]
            state[live] = self.target[arc]
            number[live] += self.skip[arc]
            step += 1
        return out

    def lengths(self, number: np.ndarray) -> np.ndarray:
        return self.start[number + 1] - self.start[number]
