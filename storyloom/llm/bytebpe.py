"""Byte-pair encoding of many words at once, in numpy, and the cutting of texts into words as two public tokenizers do it.

The classes of all characters come from Python's Unicode tables. Texts with a character that these don't
know (the library's are newer) are left to the library, as only it can tell what such a character is.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

from storyloom.llm.arrow import byte_offsets

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: White space.
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))
    return SPACE if c in _SPACES else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER


_CLASS = np.array([_class(c) for c in range(256)], np.uint8)
_ONE = np.zeros(256, bool)
_ONE[list(b"stmd")] = True


@cache
def _all_classes() -> np.ndarray:
    """The class of every code point; made where a text needs it."""
    out = np.fromiter((_class(c) for c in range(0x110000)), np.uint8, 0x110000)
    out[:256] = _CLASS
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte is part of."""
    out = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    first = data[lead]
    if first.max() < 0xC4:
        c = _CLASS[(first & 3) << 6 | data[lead + 1] & 63]
        out[lead] = out[lead + 1] = c
        return out
    extra = 1 + (first >= 0xE0) + (first >= 0xF0)
    code = (first & np.array([0, 0x1F, 0x0F, 0x07], np.uint8)[extra]).astype(np.int64)
    for k in range(1, 4):
        more = extra >= k
        code[more] = code[more] << 6 | data[lead[more] + k] & 63
    c = _all_classes()[code]
    out[lead] = c
    for k in range(1, 4):
        out[lead[extra >= k] + k] = c[extra >= k]
    return out


def known_texts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which texts hold no character that Python's Unicode tables don't know."""
    out = np.ones(len(offsets) - 1, bool)
    if len(data) and data.max() >= 0xC4:
        at = np.flatnonzero(byte_classes(data) == UNKNOWN)
        out[np.searchsorted(offsets, at, side="right") - 1] = False
    return out


def plain(column: pa.Array) -> bool:
    """Whether all characters are below U+0100."""
    data = byte_offsets(column)[1]
    return not len(data) or data.max() < 0xC4


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case, for characters below U+0100."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(lead := np.flatnonzero(data == 0xC3)):
        nxt = data[lead + 1]
        out[lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1] += 32
    return out


def composed_lower(text: str) -> str:
    """Canonical composition and lower case, a character at a time: a sigma is the same wherever it stands."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def parts(column: pa.Array, specials: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The stretches of texts between special tokens, the text of each, and the id of the token after it (-1: none)."""
    data = byte_offsets(column)[1]
    of, after = np.arange(len(column)), np.full(len(column), -1, np.int64)
    if not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
        return column, of, after
    texts, of, after = [], [], []
    for i, t in enumerate(column.to_pylist()):
        at = 0
        t = t or ""
        while (found := min(((k, s) for s in specials if (k := t.find(s, at)) >= 0), default=None)) is not None:
            texts.append(t[at : found[0]])
            of.append(i)
            after.append(specials[found[1]])
            at = found[0] + len(found[1])
        texts.append(t[at:])
        of.append(i)
        after.append(-1)
    return pa.array(texts, pa.string()), np.array(of, np.int64), np.array(after, np.int64)


def with_specials(count: np.ndarray, ids: np.ndarray, of: np.ndarray, after: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each of n texts from those of its parts, with the special tokens between them."""
    special = after >= 0
    if special.any():
        ids = np.insert(ids, np.cumsum(count)[special], after[special].astype(np.uint32))
    return np.bincount(of, weights=count + special, minlength=n).astype(np.int64), ids


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _contract(start: np.ndarray, cls: np.ndarray, data: np.ndarray, edge: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll are words where a lone apostrophe begins one."""
    n = len(data)
    at = np.flatnonzero((data == 0x27) & start[:n])
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & start[at + 1] & ~edge[at + 1]]
    if not len(at):
        return
    a = data[at + 1]
    there = at + 2 < n
    second = np.where(there, at + 2, at)
    more = there & (cls[second] == LETTER) & ~edge[second]
    b = np.where(more, data[second], 0)
    one = _ONE[a]
    two = more & (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))
    start[at[one | two] + 1] = False
    for ends in (at[one] + 2, at[two] + 3):
        ends = ends[ends < n]
        start[ends[(cls[ends] == LETTER) & ~edge[ends]]] = True


def _edges(offsets: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    return edge


def lower_word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without white space (runs of letters, single numbers, runs of others, contractions) of lower-cased bytes, and each text's first."""
    n = len(data)
    cls, edge = byte_classes(data), _edges(offsets, n)
    full = cls != SPACE
    start = np.zeros(n + 1, bool)
    start[:n] = full
    start[1:n] &= (cls[1:] != cls[:-1]) | edge[1:n] | ((cls[1:] == NUMBER) & ((data[1:] & 0xC0) != 0x80))
    _contract(start, cls, data, edge)
    stop = start | edge
    stop[1:n] |= ~full[1:]
    stop[n] = True
    stops = np.flatnonzero(stop)
    starts = np.flatnonzero(start)
    return starts, stops[np.searchsorted(stops, starts) + 1], np.searchsorted(starts, offsets)


def spaced_word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with at most one leading space, and white space; all bytes are covered."""
    n = len(data)
    cls, edge = byte_classes(data), _edges(offsets, n)
    start = edge.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    # white space before a word gives its last character to the word, if a plain space, and else to itself
    b = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~edge[1:n]) + 1 if n else np.empty(0, np.int64)
    lead = b - 1
    for _ in range(2):
        lead = lead - ((data[lead] & 0xC0) == 0x80)
    start[lead] = True
    start[b[data[b - 1] == 0x20]] = False
    start[n] = False
    _contract(start, cls, data, edge)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in keep else chr(256 + n)
        n += b not in keep
    return out


class PairTable:
    """Rank and product of each pair of symbols that merges: an open hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(left) + 1).bit_length())
        key = self._key(left, right)
        self.keys, self.rank, self.out = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.uint32)
        todo, at, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(todo):  # each slot takes one key a round
            self.probes += 1
            free = self.keys[at[todo]] == 0
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.rank[at[put]], self.out[at[put]] = key[put], put, out[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 if it doesn't merge."""
        key = self._key(a, b)
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, at, -1)
        open_ = np.flatnonzero((got != key) & (got != 0))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            out[open_[got == key]] = at[got == key]
            more = (got != key) & (got != 0)
            open_, at, key = open_[more], at[more], key[more]
        return out


NEVER = np.int32(2**31 - 1)


class ByteBPE:
    """Merges of a byte-level vocabulary file; ``encode`` takes the words that numpy suits, ``encode_long`` any."""

    LONG = 96

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = lambda xs: np.array([vocab[x] for x in xs], np.uint32)
        self.pairs = PairTable(ids(a for a, _ in pairs), ids(b for _, b in pairs), ids(a + b for a, b in pairs))
        letters = byte_letters()
        self.first, self.last = ids(letters), ids(x + suffix for x in letters)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        short = length <= self.LONG
        if not short.all():
            out: list = [None] * len(words)
            count, ids = self.encode([w for w, s in zip(words, short.tolist(), strict=True) if s])
            for i, x in zip(np.flatnonzero(short).tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=False):
                out[i] = x
            for i in np.flatnonzero(~short).tolist():
                out[i] = self.encode_long(words[i])
            return np.fromiter(map(len, out), np.int64, len(out)), np.concatenate(out).astype(np.uint32)
        if not len(words):
            return length, np.empty(0, np.uint32)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(length)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        return self._merge(length, sym)

    def _merge(self, length: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_word, done_count, done_ids = [], [], []
        word = np.arange(len(length))

        def slots(at: np.ndarray) -> np.ndarray:
            return self.pairs.find(sym[at], sym[at + 1])

        pair = np.full(len(sym), -1, np.int64)
        inner = np.ones(len(sym), bool)
        inner[np.cumsum(length) - 1] = False
        at = np.flatnonzero(inner)
        pair[at] = slots(at)
        while True:
            rank = np.where(pair >= 0, self.pairs.rank[pair], NEVER)
            begin = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, begin)
            live = least < NEVER
            if not live.all():
                stays = np.repeat(live, length)
                done_word.append(word[~live])
                done_count.append(length[~live])
                done_ids.append(sym[~stays])
                word, length, least = word[live], length[live], least[live]
                sym, pair, rank = sym[stays], pair[stays], rank[stays]
                begin = np.cumsum(length) - length
            if not len(word):
                break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            of = np.searchsorted(begin, hit, side="right") - 1
            at = hit[np.concatenate([[True], of[1:] != of[:-1]])]  # the leftmost of each word
            sym[at] = self.pairs.out[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            ends = begin + length - 1
            tail = at + 1 == ends  # the merged symbol is the word's last now
            at -= np.arange(len(at))
            length = length - 1
            sym, pair = sym[keep], pair[keep]
            begin = np.cumsum(length) - length
            pair[at[tail]] = -1
            left, right = at[at > begin] - 1, at[~tail]
            pair[left], pair[right] = slots(left), slots(right)
        words, count = np.concatenate(done_word), np.concatenate(done_count)
        ids = np.concatenate(done_ids)
        from storyloom.llm.arrow import gather

        order = np.argsort(words, kind="stable")
        return count[order], gather((np.cumsum(count) - count)[order], count[order], ids)

    def encode_long(self, word: bytes) -> np.ndarray:
        """One long word: pairs wait in a heap, symbols are a linked list."""
        import heapq

        sym = [*self.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        nxt, prev, alive = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)], [True] * len(sym)
        slots = self.pairs.find(np.array(sym[:-1], np.uint32), np.array(sym[1:], np.uint32))
        heap = [(int(self.pairs.rank[s]), i, sym[i], sym[i + 1], int(self.pairs.out[s])) for i, s in enumerate(slots.tolist()) if s >= 0]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j >= 0 and (s := self._one(sym[i], sym[j])) >= 0:
                heapq.heappush(heap, (int(self.pairs.rank[s]), i, sym[i], sym[j], int(self.pairs.out[s])))

        while heap:
            _, i, a, b, out = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = out, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return np.array([s for s, x in zip(sym, alive, strict=True) if x], np.uint32)

    @cached_property
    def _slots_by_pair(self) -> dict[int, int]:
        at = np.flatnonzero(self.pairs.keys)
        return dict(zip((self.pairs.keys[at] - np.uint64(1)).tolist(), at.tolist(), strict=True))

    def _one(self, a: int, b: int) -> int:
        return self._slots_by_pair.get(a << 32 | b, -1)
