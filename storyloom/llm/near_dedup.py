"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

Shingles are five words (A-Z lower-cased; a text of one to four words has one of all
of them), weighted by (1 + log2 tf) * (1 + DAMP * idf). The idf is ln(N / df) against
ln(1 / FLOOR), 1 at most: a shingle that fewer than FLOOR of all documents hold counts as
one that FLOOR of them hold. So it doesn't change with the number of documents,
and 2**18 hashed counters over all documents suffice: what other shingles add to a counter is
about the same for all, is estimated by the median and taken off. The damping keeps
the weight of a shingle that a large group of copies shares near that of others: undamped,
copies would look the less alike the more of them there are.

Improved consistent weighted sampling draws for each of 64 samples the shingle
with the least ln a = ln c - r (t - beta) - r, t = floor(ln w / r + beta); two texts draw the
same (shingle, t) with the probability of their weighted Jaccard similarity. The variates
r, c, beta come from a table by a hash of the shingle, and weights are rounded to
eighths of an octave for the draw (not for the check). 16 bands of 4 samples make buckets.

Texts with equal shingles are one node. Links are found in two steps, each a
bounded number of jobs whatever the data. First, in the buckets of a few bands, each member is compared with two centres
of its bucket by exact weighted Jaccard similarity, which makes one class of most groups of copies. Then, in
each bucket of any band that still holds several classes, all members of different classes are
compared: the bucket's largest class and its other members are dealt into blocks of bounded size, and each block of others meets each
block, in one task, as rows of sparse matrices. Members of the largest class never meet each other, so a
bucket costs its members times the blocks of those that are not of that class. No bucket is capped or
sampled: each pair that shares a bucket is in one class already, or is compared, or differs too much in weight.

Defined cases: a null or empty text has no shingles, and all such texts are one class;
rows with the same ``doc_id`` are one document and end up in one class; for a null
``doc_id`` stands a number from 2**62 on made of the text's hash, so that rows without an id and
with equal texts are one document and a class is named by a real id if it has one; ties don't matter,
as a class is named by its least id; an empty table gives an empty result. Extra columns
are not read by ``near_classes`` and pass through ``keep_one``; only names that begin with ``_near_`` are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.llm.arrow import as_binary, byte_offsets, lean, pieces
from storyloom.llm.common import Scratch, documents
from storyloom.llm.graph import components, with_group
from storyloom.llm.spans import hash_spans, mix, word_spans

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
DF_BITS, DAMP, FLOOR = 18, 0.25, 1 / 128
_VARIATES, _LEVELS, _PER_OCTAVE = 1 << 14, 64, 8
#: Bands whose buckets are joined first, and the members of a bucket that all others meet then.
FIRST_BANDS, CENTRES = 4, 2
#: Members of a block, and their shingles.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18
#: Bits of the filter for a node, and in all; where more are needed, a join takes the filter's place.
NODE_BITS, MOST_BITS = 16, 1 << 27


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles of each text, by text and hash."""
    offsets, data = byte_offsets(column)
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    starts, ends, first = word_spans(offsets, data)
    (w,) = hash_spans(data, starts, ends, 1)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    last = first[1:][text]
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        there = at + j < last
        h = h * np.uint64(0xD1342543DE82EF95) + np.where(there, w[np.minimum(at + j, max(0, len(w) - 1))], 0) if len(w) else h
    h = mix(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    return text[begin], h[begin], np.diff(np.append(begin, len(h)))


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """Weights of the hashed counters, and the number of documents: all the driver gets is one number a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << DF_BITS, np.int64)
        for b in pieces(batches):
            _, h, _ = shingles(b.column(0))
            n += np.bincount((h >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["counter", "n"])

    got = df.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << DF_BITS)
    n[got["counter"].to_numpy()] = got["n"].to_numpy()
    return n, df.count()


def idf_table(n: np.ndarray, documents: int, damp: float = DAMP) -> np.ndarray:
    share = (n - np.median(n)) / max(1, documents)
    return 1 + damp * np.minimum(1, np.log(np.clip(share, FLOOR, 1)) / np.log(FLOOR))


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log2(tf)) * idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]


class Sampler:
    """The draws of improved consistent weighted sampling, tabled by level of weight and by variate."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2, 1, _VARIATES), rng.gamma(2, 1, _VARIATES), rng.random(_VARIATES)
        level = np.log(2.0) * np.arange(_LEVELS)[:, None] / _PER_OCTAVE
        t = np.floor(level / r + beta)
        a = (np.log(c) - r * (t - beta) - r).astype(np.float32)
        bits = a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # as unsigned numbers, in the order of a
        self.table = (ordered << np.uint64(32) | (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))).ravel()
        self.factor = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, begin: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each text (its shingles begin there) and sample, what was drawn."""
        level = np.clip(np.rint(np.log2(w) * _PER_OCTAVE), 0, _LEVELS - 1).astype(np.int64) * _VARIATES
        low = h & np.uint64(0xFFFFFFFF)
        out = np.empty((len(begin), len(self.factor)), np.uint32)
        for k, f in enumerate(self.factor):
            key = self.table[((h * f) >> np.uint64(50)).astype(np.int64) + level]
            key ^= low
            out[:, k] = np.minimum.reduceat(key, begin)
        return out


def _sums(begin: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin)


SIGNED = "id long, doc_id long, k1 long, k2 long, weight double, size int, bands array<long>"


def signatures(df: DataFrame, idf) -> DataFrame:
    """(id, doc_id, k1, k2, weight, size, bands) of (id, text, doc_id): 128 bits that equal shingles share, their total weight and number, and a hash for each band (none without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in pieces(batches):
            text, h, tf = shingles(b.column(1))
            k1, k2 = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
            bands = np.zeros((len(b), BANDS), np.uint64)
            full, total = np.zeros(len(b), bool), np.zeros(len(b))
            size = np.bincount(text, minlength=len(b)).astype(np.int32)
            if len(h):
                at, begin = np.unique(text, return_index=True)
                full[at] = True
                t = tf.astype(np.uint64)
                k1[at], k2[at] = _sums(begin, mix(h + t)), _sums(begin, mix(h * np.uint64(0x9E3779B97F4A7C15) + t))
                w = weights(h, tf, idf.value)
                total[at] = _sums(begin, w)
                drawn = sampler.draw(begin, h, w).astype(np.uint64).reshape(len(at), BANDS, ROWS)
                key = np.zeros((len(at), BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key + drawn[:, :, r] + salt)
                bands[at] = key
            count = np.where(full, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(bands[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(total), pa.array(size), lists], ["id", "doc_id", "k1", "k2", "weight", "size", "bands"])

    return df.mapInArrow(lean(run), SIGNED)


def shingle_sets(df: DataFrame, wanted=None) -> DataFrame:
    """(node, hashes, counts) of (node, text), where ``wanted`` is given only of nodes whose bit is set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            if wanted is not None:
                b = b.filter(pa.array(_is_set(wanted.value, b.column(0).to_numpy())))
            if not len(b):
                continue
            text, h, tf = shingles(b.column(1))
            ends = np.searchsorted(text, np.arange(1, len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), as_binary(ends, h), as_binary(ends, np.minimum(tf, 65535).astype(np.uint16))], ["node", "hashes", "counts"])

    return df.mapInArrow(lean(run), "node long, hashes binary, counts binary")


def _slots(nodes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(nodes.view(np.uint64) + np.uint64(0)) & np.uint64(bits - 1)).astype(np.int64)


def _is_set(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    slot = _slots(nodes, 64 * len(words))
    return (words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def node_filter(nodes: DataFrame) -> np.ndarray | None:
    """Bits of which every node sets one; none where they would be more than MOST_BITS."""
    bits = 1 << max(12, (NODE_BITS * nodes.count()).bit_length())
    if bits > MOST_BITS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.unique(_slots(b.column(0).to_numpy(), bits))
            word, first = np.unique(slot >> 6, return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    got = nodes.mapInArrow(lean(run), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def similarities(pairs: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """(a, b, j): exact weighted Jaccard similarity of each pair of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j = []
            for ha, ca, hb, cb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                ha, hb = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
                wa, wb = weights(ha, np.frombuffer(ca, np.uint16), idf.value), weights(hb, np.frombuffer(cb, np.uint16), idf.value)
                _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                both = np.minimum(wa[x], wb[y]).sum()
                j.append(float(both / max(wa.sum() + wb.sum() - both, 1e-300)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j, pa.float64())], ["a", "b", "j"])

    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}"), F.col("counts").alias(f"c{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "ca", "hb", "cb")
    return met.mapInArrow(lean(run), "a long, b long, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def centre_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's centres, its members of least hash; not those too unlike in weight."""
    order = lambda i: F.struct(F.xxhash64(F.lit(i), "node").alias("h"), F.col("node"), F.col("weight"))
    names = [f"c{i}" for i in range(CENTRES)]
    x = with_group(rows, ["bucket"], "node", {c: (order(i), F.min) for i, c in enumerate(names)})
    fit = lambda c: (c["node"] != F.col("node")) & (F.least("weight", c["weight"]) >= (threshold - 1e-9) * F.greatest("weight", c["weight"]))
    x = x.select("node", F.explode(F.array_distinct(F.filter(F.transform(F.array(*names), lambda c: F.struct(c["node"].alias("node"), c["weight"].alias("weight"))), fit))).alias("c"))
    return x.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, n, t, main): buckets with several classes, their members and these members' shingles, and count, class and
    shingles of the largest class; of buckets with the same members one. Members are summed by class before a bucket's classes meet."""
    xor = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(salt)
    parts = rows.groupBy("bucket", "class").agg(F.count("*").alias("nc"), F.sum(F.col("size").cast("long")).alias("tc"), xor("x"), xor("y"))
    sums = [F.sum("nc").alias("n"), F.sum("tc").alias("t"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("nc", "class", "tc")).alias("main")]
    whole = parts.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), *sums).filter("low <> high")
    return whole.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "t", "main")).alias("b")).select("b.bucket", "n", "b.t", "b.main")


def blocks(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """(gid, side, node, class) of (bucket, node, class): members of ``mixed_buckets``, dealt into groups of
    two blocks at most. Sides 0 and 1 are to be compared with each other, those of side 2 among themselves."""
    x = rows.select("bucket", "node", "class").join(buckets, "bucket")
    count = lambda n, t: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(t / BLOCK_SHINGLES)).cast("int")
    x = x.withColumn("bm", count(F.col("main.nc"), F.col("main.tc"))).withColumn("bo", count(F.col("n") - F.col("main.nc"), F.col("t") - F.col("main.tc")))
    is_main = F.col("class") == F.col("main.class")
    x = x.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(is_main, F.col("bm")).otherwise(F.col("bo"))).cast("int"))
    group = lambda kind, i, j, side: F.struct(F.xxhash64(F.lit(kind), "bucket", i, j).alias("gid"), side.alias("side"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, zero = F.col("own"), F.lit(0)
    as_main = F.transform(to("bo"), lambda j: group("main", own, j, F.lit(0)))
    with_main = F.transform(to("bm"), lambda i: group("main", i, own, F.lit(1)))
    others = F.transform(to("bo"), lambda j: group("other", F.least(own, j), F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    small = (F.col("n") <= BLOCK) & (F.col("t") <= BLOCK_SHINGLES)
    to_groups = F.when(small, F.array(group("all", zero, zero, F.lit(2)))).when(is_main, as_main).otherwise(F.concat(with_main, others))
    return x.select("node", "class", F.explode(to_groups).alias("g")).select("g.gid", "g.side", "node", "class")


def alike(side: np.ndarray, cls: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between the classes of a group, as many as join them: (class, class) of members that are alike enough."""
    length = np.array([len(h) for h in hashes])
    h, tf, at = np.concatenate(hashes), np.concatenate(counts).astype(np.int64), np.repeat(np.arange(len(hashes)), length)
    more = np.repeat(np.arange(len(h)), tf)  # the k-th of a shingle's repeats is an element by itself: what two texts share are minima
    k = np.arange(len(more)) - np.repeat(np.cumsum(tf) - tf, tf) + 1
    gain = np.where(k == 1, 1, np.log2(k) - np.log2(np.maximum(k - 1, 1)))
    w = gain * idf[(h[more] >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    total = np.bincount(at[more], weights=w, minlength=len(hashes))
    _, first, column, n = np.unique(mix(h[more] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    held = np.flatnonzero(n > 1)
    new = np.full(len(n), -1)
    new[held] = np.arange(len(held))
    element, column = np.flatnonzero(n[column] > 1), new[column[n[column] > 1]]
    order = np.argsort(column, kind="stable")
    element, column = element[order], column[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    both = np.zeros((len(left), len(right)))
    for lo in range(0, len(held), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(hashes), min(4096, len(held) - lo)))
        m[at[more[element[a:b]]], column[a:b] - lo] = 1
        both += m[left] * w[first[held[lo : lo + 4096]]] @ m[right].T
    j = both / np.maximum(total[left][:, None] + total[right][None, :] - both, 1e-300)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    out = []
    for a, b in zip(*np.nonzero((j >= threshold) & (cls[left][:, None] != cls[right][None, :])), strict=True):
        ca, cb = find(int(cls[left[a]])), find(int(cls[right[b]]))
        if ca != cb:
            root[max(ca, cb)] = min(ca, cb)
            out.append((min(ca, cb), max(ca, cb)))
    return out


def block_links(dealt: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): classes that hold members as alike as the threshold, by the groups of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> list[tuple[int, int]]:
            side, cls = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            if len(rows) < 2 or (cls == cls[0]).all():
                return []
            return alike(side, cls, [np.frombuffer(r[3], np.uint64) for r in rows], [np.frombuffer(r[4], np.uint16) for r in rows], idf.value, threshold)

        group: list[tuple] = []
        for b in batches:
            links = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[0] != group[0][0]:
                    links += found(group)
                    group = []
                group.append(r)
            if links:
                yield _links(links)
        if group and (links := found(group)):
            yield _links(links)

    x = dealt.join(sets, "node").select("gid", "side", "class", "hashes", "counts").repartition("gid").sortWithinPartitions("gid")
    return x.mapInArrow(lean(run), "a long, b long").distinct()


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _id():
    """The document's id, or what stands for a null one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2) + F.lit(1 << 62))


def near_classes(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies): every document's class, named by its least id, and the number of documents with equal shingles."""
    return _classes(df, threshold).drop("id")


def _classes(df: DataFrame, threshold: float) -> DataFrame:
    """The same with ``id``, which is never null."""
    sc, scratch = df.sparkSession.sparkContext, Scratch(df.sparkSession)
    docs = df.select(_id().alias("id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    idf = sc.broadcast(idf_table(*document_frequencies(docs)))
    signed = scratch.written(signatures(docs, idf), "signatures")
    groups = with_group(signed.select("doc_id", "id", "k1", "k2", F.lit(1).alias("_one")), ["k1", "k2"], "id", {"rep": (F.col("id"), F.min), "n_copies": (F.col("_one"), F.count)})
    members = scratch.written(groups.drop("_one"), "members")
    nodes = signed.join(members.filter("id = rep").select("id", "k1", "k2"), ["id", "k1", "k2"], "left_semi").dropDuplicates(["id"])
    rows = nodes.select(F.col("id").alias("node"), "weight", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    shared = scratch.written(rows.join(shared, "bucket"), "buckets")
    wanted = shared.select("node").distinct()
    bits = node_filter(wanted)
    texts = docs.select(F.col("id").alias("node"), "text", F.col("doc_id").isNull().alias("no_id"))
    if bits is None:
        texts, filtered = texts.join(wanted, "node", "left_semi"), None
    else:
        filtered = sc.broadcast(bits)
    sets = shingle_sets(texts.filter("not no_id"), filtered).unionByName(shingle_sets(texts.filter("no_id"), filtered).dropDuplicates(["node"]))
    sets = scratch.written(sets, "sets")
    # texts that came under one id are one document
    several = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).join(members.filter("id = rep").select(F.col("id").alias("a")), "a", "left_semi")
    met = similarities(centre_pairs(shared.filter(F.col("band") < FIRST_BANDS), threshold), sets, idf).filter(F.col("j") >= threshold)
    first = scratch.written(components(several.union(met.select("a", "b")).distinct(), scratch), "first").withColumnRenamed("class", "_class")
    classed = scratch.written(shared.join(first, "node", "left").withColumn("class", F.coalesce("_class", "node")).select("bucket", "node", "class", "size"), "classed")
    dealt = blocks(classed, scratch.written(mixed_buckets(classed), "mixed"))
    second = components(block_links(dealt, sets, idf, threshold), scratch).select(F.col("node").alias("_class"), F.col("class").alias("_last"))
    out = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("_class", F.coalesce("_class", "rep")).join(second, "_class", "left")
    return scratch.last(out.select("id", "doc_id", F.coalesce("_last", "_class").alias("class_id"), F.col("n_copies").cast("long").alias("n_copies")), "classes")


def keep_one(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns that came, one document of each class: the one with the least id. Of rows with one id the first text, by its hash, stays."""
    stays = _classes(df, threshold).filter("id = class_id").select(F.col("id").alias("_near_stays")).distinct()
    first = W.partitionBy("_near_id").orderBy("_near_hash")
    rows = df.withColumn("_near_id", _id()).withColumn("_near_hash", F.xxhash64(F.col("text").cast("string")))
    rows = rows.withColumn("_near_n", F.row_number().over(first)).filter("_near_n = 1")
    return rows.join(stays, rows["_near_id"] == F.col("_near_stays"), "left_semi").drop("_near_id", "_near_hash", "_near_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _classes(documents(spark, sf_dir), THRESHOLD)
    return c.select("doc_id", "class_id", "n_copies", (F.col("id") == F.col("class_id")).alias("kept"))
