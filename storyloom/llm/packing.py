"""Packing documents into training sequences by order-preserving dynamic programming.

Documents are tokenised (a word's ids are looked up once and remembered), each
followed by an end id, and lie one after the other in the order in which they are
stored; nothing is shuffled. A stream is cut into windows of at most ``size`` tokens
at document ends, sentence ends (a word that ends in . ! or ?) or, in a sentence longer
than a window, within it. A cut costs nothing, ``sentence_cost`` or ``hard_cost``; a window
costs its padding up to ``size``, or ``SHORT_COST`` at a lower power of two from 256 on. The cheapest cuts come from

    f(j) = cost(j) + min over windows [i, j) of f(i) + size - (j - i),

whose minimum over i is the front of a monotone queue, as f(i) + i does not depend on
j; windows of a power of two are looked up by their start. The last window of a
block may also be cut into powers of two, at ``hard_cost`` each.

Blocks of ``block`` tokens (or one longer document) are packed independently, so that
memory is bounded; the sequence id holds the task and the number within it.

Defined cases: a null or empty text has only the end id; a null ``doc_id`` stays null;
repeated rows are packed as often as they come; an empty table gives no pieces.
Only the id and text columns are read, so that extra columns never clash.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.arrow import as_binary, byte_offsets, lean, pieces
from storyloom.llm.bytebpe import ByteBPE, composed_lower, known_texts, lower_word_spans, lowered, parts, plain, special_tokens
from storyloom.llm.common import SPACE_CLASS, documents
from storyloom.llm.spans import WordTable

SIZE, BLOCK, END_ID = 4096, 1 << 21, 2
SENTENCE_COST, HARD_COST, SHORT_COST = 8, 64, 16
WORDS = re.compile(SPACE_CLASS.replace("[", "[^") + "+")
_FINAL = np.zeros(256, bool)
_FINAL[list(b".!?")] = True
_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Ids of whole texts, for a byte-level vocabulary that drops white space and lower-cases; right as its library is.

    Words are looked up in a table that outlives a task; texts with a character newer than Python's Unicode tables go through the library word by word.
    """

    def __init__(self, path: str) -> None:
        self.path, self.specials = path, special_tokens(path)
        self.table = WordTable(ByteBPE(path).encode)

    @staticmethod
    def of(path: str) -> TextEncoder:
        return _encoders.get(path) or _encoders.setdefault(path, TextEncoder(path))

    @cached_property
    def tokenizer(self):
        """The library, loaded where a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, all ids, and for each id whether a sentence ends after it."""
        inner, of, after = parts(column, self.specials)
        count, ids, stop = self._parts(inner)
        if (special := after >= 0).any():
            at = np.cumsum(count)[special]
            ids, stop = np.insert(ids, at, after[special].astype(np.uint32)), np.insert(stop, at, False)
        return np.bincount(of, weights=count + special, minlength=len(column)).astype(np.int64), ids, stop

    def _parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if plain(column):
            offsets, data = byte_offsets(column)
            return self._simple(offsets, lowered(data))
        known = known_texts(*byte_offsets(column))
        out = []
        at = 0
        while at < len(known):  # runs of texts of either kind
            to = at + 1
            while to < len(known) and known[to] == known[at]:
                to += 1
            some = column.slice(at, to - at).to_pylist()
            out.append(self._simple(*byte_offsets(pa.array([composed_lower(t or "") for t in some], pa.large_string()))) if known[at] else self._any(some))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _simple(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = lower_word_spans(offsets, data)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.uint32), np.empty(0, bool)
        length, ids = self.table.take(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(length)])
        stop = np.zeros(len(ids), bool)
        # the next word doesn't touch this one
        stop[total[1:][_FINAL[data[ends - 1]] & np.append(starts[1:] != ends[:-1], True)] - 1] = True
        return np.diff(total[first]), ids, stop

    def _any(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths, ids, stop = [], [], []
        for t in texts:
            words = WORDS.findall(t or "")
            n = 0
            for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
                ids += e.ids
                stop += [False] * (len(e.ids) - 1) + [w[-1] in ".!?"] * bool(e.ids)
                n += len(e.ids)
            lengths.append(n)
        return np.array(lengths, np.int64), np.array(ids, np.uint32), np.array(stop, bool)


def cut(ends: np.ndarray, cost: np.ndarray, size: int = SIZE, hard_cost: int = HARD_COST) -> list[int]:
    """The cheapest cuts of a stream. ends: where it may be cut, ascending, the last at its end; cost: of a cut there."""
    gaps = np.diff(np.concatenate([[0], ends]))
    if (gaps > size).any():  # no allowed cut for longer than a window
        more = [np.arange(e - g + size, e, size) for e, g in zip(ends[gaps > size], gaps[gaps > size], strict=True)]
        ends, cost = np.concatenate([ends, *more]), np.concatenate([cost, np.full(sum(map(len, more)), hard_cost)])
        order = np.argsort(ends, kind="stable")
        ends, cost = ends[order], cost[order]
    ends = np.concatenate([[0], ends])
    short: dict[int, list[int]] = {}  # the few windows of a power of two
    for k in range(8, size.bit_length() - 1):
        i = np.searchsorted(ends, ends - (1 << k))
        for j in np.flatnonzero(ends[i] == ends - (1 << k)).tolist():
            short.setdefault(j, []).append(int(i[j]))
    at, pay = ends.tolist(), [0, *cost.tolist()]
    best, came = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f(i) + i, i's place, i: the first is the least
    for j in range(1, len(at) - 1):
        p = at[j]
        low = p - size
        while queue[0][1] < low:
            queue.popleft()
        head = queue[0]
        f, i = head[0] + size - p, head[2]
        if j in short:
            for q in short[j]:
                if best[q] + SHORT_COST < f:
                    f, i = best[q] + SHORT_COST, q
        f += pay[j]
        best[j], came[j] = f, i
        g = f + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, p, j))
    p, j = at[-1], len(at) - 1
    last = min((best[i] + min(size - p + at[i], hard_cost * ((p - at[i]).bit_count() - 1)), i) for i in range(max(0, np.searchsorted(at, p - size)), j))
    i = last[1]
    out, rest = [p], p - at[i]
    if hard_cost * (rest.bit_count() - 1) < size - rest:  # the end in powers of two
        for k in range(rest.bit_length()):
            if rest >> k & 1 and rest != 1 << k:
                out.append(out[-1] - (1 << k))
                rest -= 1 << k
    while i:
        out.append(at[i])
        i = came[i]
    return out[::-1]


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, block: int = BLOCK, end_id: int = END_ID, sentence_cost: int = SENTENCE_COST, hard_cost: int = HARD_COST) -> DataFrame:
    """One row for each piece of a document in a sequence: where it starts in the document and in the sequence, and its ids (little-endian unsigned 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, n, task = TextEncoder.of(tokenizer), 0, TaskContext.get().partitionId()

        def solve(docs: list, lens: list, ids: list, stops: list) -> Iterator[pa.RecordBatch]:
            nonlocal n
            doc_len, flat, stop = np.concatenate(lens), np.concatenate(ids), np.concatenate(stops)
            doc_end = np.cumsum(doc_len)
            cost = np.where(stop, sentence_cost, -1)
            cost[doc_end - 1] = 0
            may = np.flatnonzero(cost >= 0)
            cuts = np.array(cut(may + 1, cost[may], size, hard_cost))
            ends = np.union1d(doc_end, cuts)
            starts = np.concatenate([[0], ends[:-1]])
            d, s = np.searchsorted(doc_end, starts, side="right"), np.searchsorted(cuts, starts, side="right")
            begun = np.concatenate([[0], cuts[:-1]])
            col = [pa.chunked_array(docs).combine_chunks().take(pa.array(d)), *map(pa.array, (starts - (doc_end - doc_len)[d], ends - starts, doc_len[d], (task << 32) + n + s, starts - begun[s]))]
            yield pa.RecordBatch.from_arrays([*col, as_binary(ends, flat)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            n += len(cuts)

        held: tuple[list, list, list, list] = ([], [], [], [])
        count = 0
        for b in pieces(batches):
            lengths, ids, stop = words.encode(b.column(1))
            ends = np.cumsum(lengths)
            new = np.insert(ids, ends, end_id)
            new_stop = np.insert(stop, ends, False)
            for x, v in zip(held, (b.column(0), lengths + 1, new, new_stop), strict=True):
                x.append(v)
            count += len(new)
            if count >= block:
                yield from solve(*held)
                held, count = ([], [], [], []), 0
        if count:
            yield from solve(*held)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(documents(spark, sf_dir), default_tokenizer())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
