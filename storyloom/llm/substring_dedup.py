"""Exact repeats of 200 bytes within and across documents, found with suffix arrays.

A byte goes if a 200-byte string that covers it starts anywhere else, too. Suffix
arrays of a whole corpus would be too large to build and to hold, so they are built of
what can repeat, in shards:

1. Each window of 200 bytes has an anchor: its 64-byte string with the least hash, the
   leftmost of equals. Equal windows have equal anchors at equal places; one anchor serves the
   windows of a whole stretch. Anchors are counted; windows whose anchor occurs once
   cannot repeat.
2. Stretches of windows with repeated anchors are segments. Equal segments become one, and so
   do equal pieces (the windows of one anchor): all windows of such pieces repeat.
3. Pieces with equal anchors but different surroundings are dealt to shards by anchor, so
   that equal windows meet. Each shard is suffix-sorted by induced sorting, and its permuted
   common prefixes tell which windows share 200 bytes with a neighbour in the array.
4. What repeats is mapped back to segments and documents, and its bytes are cut out.

Strings are compared byte by byte in the arrays; whole segments and pieces by 128-bit and
64-bit hashes. A filter of fixed size only saves work: it lets through every repeated anchor.

Rows are numbered by task and place in it, so the input must read the same each time, as
a stored table does. Defined cases: a null text counts as the empty one; texts of less than
200 bytes lose nothing; a null ``doc_id`` stays null; repeated rows are different
places, so what they share goes from each; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.arrow import as_binary, byte_offsets, pieces
from storyloom.llm.common import documents, written
from storyloom.llm.graph import with_group
from storyloom.llm.spans import _power_tables, mix
from storyloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 200, 64
#: Bytes of a shard that are suffix-sorted at once; pieces of one anchor stay together.
SHARD_BYTES = 1 << 20
#: Bytes whose windows are told at once; positions among them have 28 bits.
AT_ONCE, _POS = 1 << 24, np.uint64((1 << 28) - 1)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(max(1 << 20, len(data) + 1))[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def anchored(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text, first start, end of starts, anchor's hash. Long data are worked on in
    parts that overlap by a window less one byte; a run that lies in two parts comes as two."""
    if len(data) < AT_ONCE + length:
        return _anchored(offsets, data, length, gram)
    out = []
    for lo in range(0, len(data) - length + 1, AT_ONCE):
        hi = min(len(data), lo + AT_ONCE + length - 1)
        a, b = np.searchsorted(offsets, lo, side="right"), np.searchsorted(offsets, hi, side="left")
        text, first, end, h = _anchored(np.concatenate([[0], offsets[a:b] - lo, [hi - lo]]), data[lo:hi], length, gram)
        out.append((text + a - 1, first + lo, end + lo, h))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchored(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n, grams = len(data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64)
    total, down = _prefix(data)
    h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= grams:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < grams:
        m = np.minimum(m[: len(h) - grams + 1], m[grams - size : grams - size + len(h) - grams + 1])
    at = (m & _POS).astype(np.int64)  # the anchor of each start
    text = np.searchsorted(offsets, np.arange(len(at)), side="right") - 1
    valid = np.arange(len(at)) + length <= offsets[text + 1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(first)
    stop = np.append(first[1:] | ~valid[1:], True) & valid
    hi = np.flatnonzero(stop) + 1
    return text[lo], lo, hi, h[at[lo]]


def _filter_bits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (keys & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bits_of(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """A filter of ``size`` bits (at most 2**27) of which each key sets one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for b in batches:
            slot = (b.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["word", "bits"])

    got = keys.select(column).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _size_for(n: int) -> int:
    return 1 << min(27, max(16, int(16 * n).bit_length()))


def repeated_anchors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            u, n = np.unique(anchored(*byte_offsets(b.column(0)))[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def segments(docs: DataFrame, bits) -> DataFrame:
    """(row, lo, s1, s2, windows, bytes): stretches of windows with repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for b in pieces(batches):
            offsets, data = byte_offsets(b.column(1))
            text, lo, hi, h = anchored(offsets, data)
            keep = _filter_bits(h, bits.value)
            text, lo, hi = text[keep], lo[keep], hi[keep]
            if len(lo):
                begin = np.concatenate([[True], (lo[1:] != hi[:-1]) | (text[1:] != text[:-1])])
                first = np.flatnonzero(begin)
                text, lo, hi = text[first], lo[first], hi[np.append(first[1:], len(hi)) - 1]
                total, down = _prefix(data)
                raw = data.tobytes()
                parts = [raw[a : c + LENGTH - 1] for a, c in zip(lo.tolist(), hi.tolist(), strict=True)]
                digest = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)
                cols = [(task << 40) + row + text, lo - offsets[text], digest[:, 0], digest[:, 1], hi - lo]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(parts, pa.binary())], ["row", "lo", "s1", "s2", "windows", "bytes"])
            row += len(b)

    return docs.select("doc_id", "text").mapInArrow(run, "row long, lo long, s1 long, s2 long, windows long, bytes binary")


def anchor_pieces(distinct: DataFrame) -> DataFrame:
    """(s1, s2, n, h, p, at, windows): the windows of one anchor in each distinct segment, with a hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "bytes"):
            offsets, data = byte_offsets(b.column(b.schema.get_field_index("bytes")))
            text, lo, hi, h = anchored(offsets, data)
            total, down = _prefix(data)
            end = hi + LENGTH - 1
            p = mix(mix((total[end] - total[lo]) * down[lo]) + (end - lo).astype(np.uint64))
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(3)), pa.array(h.view(np.int64)), pa.array(p.view(np.int64)), pa.array(lo - offsets[text]), pa.array(hi - lo)], ["s1", "s2", "n", "h", "p", "at", "windows"])

    return distinct.select("s1", "s2", "n", "bytes").mapInArrow(run, "s1 long, s2 long, n long, h long, p long, at long, windows long")


RUNS = "array<struct<at:long,n:long>>"
_RUNS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _runs_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"at": int(a), "n": int(c - a)} for a, c in zip(edge[::2], edge[1::2], strict=True)]


def sorted_shards(shard: DataFrame) -> DataFrame:
    """(h, p, runs): the windows of each piece that another piece of its shard shares. Rows come sorted by anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(r[2]) for r in rows], np.int64)
        flat = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64) + 2
        ends = np.cumsum(size)
        t = np.append(np.insert(flat, ends, 1), 0)  # a mark after each piece, and the end
        sa = suffix_array(t, 258)
        share, before = common_prefixes(t, sa)
        hit = share >= LENGTH
        twice = hit.copy()
        twice[before[hit]] = True
        begin = ends - size + np.arange(len(rows))
        runs = [_runs_of(twice[b : b + n - LENGTH + 1]) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, _RUNS)], ["h", "p", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= SHARD_BYTES and r[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
        if held:
            yield solve(held)

    return shard.select("h", "p", "bytes").mapInArrow(run, f"h long, p long, runs {RUNS}")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row, runs): the window starts of each row's text that repeat, as (start, number)."""
    spark = docs.sparkSession
    anchors = written(repeated_anchors(docs), "anchors")
    bits = spark.sparkContext.broadcast(_bits_of(anchors, "h", _size_for(anchors.count())))
    once = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("windows").alias("n")))
    found = written(segments(docs, bits), "segments")
    distinct = written(found.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")), "distinct")
    parts = written(anchor_pieces(distinct), "pieces")
    parts = written(with_group(parts, ["h"], "s1", {"low": (F.col("p"), F.min), "high": (F.col("p"), F.max), "times": (F.col("n"), F.sum)}).filter("times > 1"), "pieces")
    alike = parts.filter("low = high").select("s1", "s2", "at", "windows", once.alias("runs"))
    parts = written(with_group(parts.filter("low <> high").drop("low", "high", "times"), ["h", "p"], "s1", {"times": (F.col("n"), F.sum)}), "pieces")
    # one of each kind of piece whose anchor has several
    several = parts.groupBy("h", "p").agg(F.min(F.struct("s1", "s2", "at", "windows")).alias("x")).select("h", "p", "x.*")
    shard = several.join(distinct.select("s1", "s2", "bytes"), ["s1", "s2"]).select("h", "p", F.expr(f"substring(bytes, cast(at + 1 as int), cast(windows + {LENGTH - 1} as int))").alias("bytes"))
    shared = written(sorted_shards(shard.repartition("h").sortWithinPartitions("h")), "shared")
    marked = parts.join(shared, ["h", "p"], "left").withColumn("runs", F.when(F.col("times") > 1, once).otherwise(F.coalesce("runs", F.array().cast(RUNS)))).filter(F.size("runs") > 0)
    marked = marked.select("s1", "s2", "at", "windows", "runs").unionByName(alike)
    here = F.transform("runs", lambda r: F.struct((F.col("at") + r["at"]).alias("at"), r["n"].alias("n")))
    per_segment = written(marked.groupBy("s1", "s2").agg(F.flatten(F.collect_list(here)).alias("runs")), "per-segment")
    rows = found.select("row", "lo", "s1", "s2").join(per_segment, ["s1", "s2"])
    there = F.transform("runs", lambda r: F.struct((F.col("lo") + r["at"]).alias("at"), r["n"].alias("n")))
    return rows.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list(there))).alias("runs"))


def removed_spans(runs: list[dict]) -> list[list[int]]:
    """Maximal byte spans that the windows of sorted runs cover."""
    out: list[list[int]] = []
    for r in runs:
        a, c = r["at"], r["at"] + r["n"] - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c)
        else:
            out.append([a, c])
    return out


def dedup(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) of every row: the byte spans that go (end exclusive), and the hash of what stays."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = written(repeated_runs(docs), "runs")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits_of(runs, "row", _size_for(max(1, runs.count()))))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their number; a text without repeats is done here and stays behind."""
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for b in pieces(batches):
            offsets, data = byte_offsets(b.column(1))
            rows = (task << 40) + row + np.arange(len(b))
            hit = _filter_bits(rows.view(np.uint64), wanted.value)
            raw = data.tobytes()
            texts = [raw[a:c] for a, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0), pa.array(np.diff(offsets)), pa.array(sha), pa.array([t if k else None for t, k in zip(texts, hit.tolist(), strict=True)], pa.binary())], ["row", "doc_id", "n_bytes", "sha", "bytes"])
            row += len(b)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans, sha = [], []
            for s, raw, rs in zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True):
                gone = removed_spans(rs or [])
                if gone:
                    edges = [0, *(x for g in gone for x in g), len(raw)]
                    s = hashlib.sha256(b"".join(raw[a:c] for a, c in zip(edges[::2], edges[1::2], strict=True))).hexdigest()
                sha.append(s)
                spans.append([{"start": a, "end": c} for a, c in gone])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    numbered = docs.mapInArrow(number, "row long, doc_id long, n_bytes long, sha string, bytes binary")
    met = numbered.join(runs, "row", "left").select("doc_id", "n_bytes", "sha", "bytes", "runs")
    return met.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
