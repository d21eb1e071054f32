"""Language-model scores: a log-bilinear model over word classes, beside a unigram base.

All training texts are counted and trained on; nothing is sampled from them. The ``SINGLE`` most frequent words are
classes of their own, every other word belongs to one of ``TAIL`` classes by its last
three bytes, so that a class is known for any word. The model is log-bilinear, with the classes g and h of the two tokens before:

    s(g, h, w) = (r_h C + r_g D) . q_w + b_w,    P(w | g, h) = exp s(g, h, w) / sum over w' of exp s(g, h, w')

It is trained in numpy by noise-contrastive estimation, in two steps. First, with h alone, on the
counts of all pairs of classes, with the noise (the classes' own frequencies) in expectation, on the driver, whose work doesn't grow with the corpus. Then
each task goes on from there over the tokens of its own texts in batches, with noise drawn
anew for each batch, and the tasks' parameters are averaged, weighted by their tokens. One product of matrices for each h
then gives all normalising sums, so that a batch of tokens gets normalised log-probabilities from three tables. A word
of a tail class has the class's probability times its own share of the class,
(c + 0.1) / (sum of c + 0.1, with one more 0.1 for unknown words), so that a token's
probabilities sum to 1.

Words are keyed by a 64-bit hash. The ``HEAD`` most frequent words and the model (fixed
sizes) go to every task; the other words of a text meet their counts in a join. The classes don't grow with the
corpus; the counts of words do.

Defined cases: a null or empty text has one token, its end; a null ``doc_id`` counts
as the text ''; repeated rows are scored one by one; without training texts all
counts are 0; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.arrow import byte_offsets, pieces
from storyloom.llm.common import Scratch, documents, most_frequent
from storyloom.llm.spans import hash_spans, word_spans

#: Words whose counts go to every task; classes of single words and of endings.
HEAD, SINGLE, TAIL = 1 << 17, 511, 512
END = SINGLE  # the class of a text's end, and of what stands before its first word
CLASSES = SINGLE + 1 + TAIL
ADD = 0.1
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
#: Tokens of a batch, noise classes drawn for it, and the length of a step.
BATCH, NOISE, RATE = 1 << 12, 64, 0.05


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of each word of all texts, and where each text's words begin."""
    offsets, data = byte_offsets(column)
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    starts, ends, first = word_spans(offsets, data)
    (h,) = hash_spans(data, starts, ends, 1)
    tail = np.zeros(len(starts), np.uint32)
    for k in (1, 2, 3):
        at = ends - k
        tail = tail * np.uint32(0x9E3779B1) + np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint32) if len(starts) else tail
    return h, (SINGLE + 1 + (tail >> np.uint32(16)) % TAIL).astype(np.int64), first


class Sums:
    """Sums by key that are passed on when they get many."""

    def __init__(self) -> None:
        self.keys, self.sums, self.n = [], [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.n += len(keys)
        if self.n > HELD:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64)
        u, back = np.unique(keys, return_inverse=True)
        s = np.bincount(back, np.concatenate(self.sums), len(u)).astype(np.int64) if len(u) else np.empty(0, np.int64)
        self.keys, self.sums, self.n = [u], [s], len(u)

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        k, s = self.keys[0], self.sums[0]
        self.keys, self.sums, self.n = [], [], 0
        return k, s


def split(df: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, text, held_out): one fold in ``folds``, by the checksum of the id, is held out."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(key.cast("binary")) % folds == 0).alias("held_out"))


def word_counts(train: DataFrame) -> DataFrame:
    """(h, k, c): hash, tail class and count of every word of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tails = Sums(), {}

        def flush() -> pa.RecordBatch:
            keys, n = sums.out()
            known, of = np.concatenate(tails.pop("h")), np.concatenate(tails.pop("k"))
            u, first = np.unique(known, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of[first][np.searchsorted(u, keys)].astype(np.int32)), pa.array(n)], ["h", "k", "c"])

        for b in pieces(batches):
            h, k, _ = words_of(b.column(0))
            if not len(h):
                continue
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            sums.add(u, n)
            tails.setdefault("h", []).append(u)
            tails.setdefault("k", []).append(k[first].astype(np.int32))
            if sums.n > HELD // 2 or sum(map(len, tails["h"])) > 4 * HELD:
                yield flush()
        if tails:
            yield flush()

    return train.select("text").mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.first("k").alias("k"), F.sum("c").alias("c"))


class Head:
    """The frequent words, sorted by hash: count and class of each."""

    def __init__(self, h: np.ndarray, c: np.ndarray, k: np.ndarray) -> None:
        cls = k.astype(np.int64)
        cls[: min(SINGLE, len(h))] = np.arange(min(SINGLE, len(h)))  # they come by falling count
        order = np.argsort(h)
        self.h, self.c, self.k = h[order], c[order], cls[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's place, -1 for other words."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def classes(self, at: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.k[at], tail) if len(self.h) else tail


def with_ends(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens (each text's words and its end), and of the tokens before them."""
    now = np.insert(classes, first[1:], END)
    return now, np.concatenate([[END], now[:-1]])


def two_before(before: np.ndarray) -> np.ndarray:
    """The classes two tokens before, given those one before: an end stands before a text's first two words."""
    return np.where(before == END, END, np.concatenate([[END], before[:-1]]))


def pair_counts(train: DataFrame, head) -> DataFrame:
    """(pair, n): how often each class follows another, END standing before a text's first word; pair is before * CLASSES + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for b in pieces(batches):
            h, tail, first = words_of(b.column(0))
            now, before = with_ends(head.value.classes(head.value.find(h), tail), first)
            n += np.bincount(before * CLASSES + now, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    return train.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


#: The parameters in order: context vectors, C, D, class vectors, offsets.
Parameters = list[np.ndarray]


def train_pairs(pairs: np.ndarray, dim: int = 32, noise: float = 25.0, steps: int = 250, rate: float = 0.05, seed: int = 7) -> Parameters:
    """The parameters that the counts of pairs alone give; D is zero."""
    total = max(1.0, pairs.sum())
    data = (pairs / total).astype(np.float32)
    before = data.sum(1)
    p = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    p = p.astype(np.float32)
    rng = np.random.default_rng(seed)
    r, q = (rng.normal(0, 0.1, (CLASSES, dim)).astype(np.float32) for _ in range(2))
    par = [r, np.eye(dim, dtype=np.float32), q, np.log(p)]
    m, v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
    shift = np.log(noise * p)
    against = noise * before[:, None] * p[None, :]
    scale = 1.0 / np.maximum(before, 1e-6)[:, None]  # rows of rare classes learn as fast as others
    for t in range(1, steps + 1):
        r, c, q, b = par
        rc = r @ c
        s = rc @ q.T + b
        x = 1.0 / (1.0 + np.exp(np.clip(shift - s, -30, 30)))
        g = x * against - data * (1 - x)  # of the loss, by s
        gr = (g @ q) @ c.T
        grads = [gr * scale, r.T @ (g @ q), (g.T @ rc) / p[:, None], g.sum(0) / p]
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, d in enumerate(grads):
            m[i] += 0.1 * (d - m[i])
            v[i] += 0.01 * (d * d - v[i])
            par[i] = par[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    r, c, q, b = par
    return [r, c, np.zeros_like(c), q, b]


def _row_sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    i = index[order]
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    return i[begin], np.add.reduceat(rows[order], begin)


class Trainer:
    """Steps of noise-contrastive estimation over batches of tokens, each length adapted to the squares of what came before."""

    def __init__(self, par: Parameters, p: np.ndarray, seed: int) -> None:
        self.par, self.log_noise = [x.astype(np.float32).copy() for x in par], np.log(NOISE * p).astype(np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in self.par]
        self.rng, self.cum, self.tokens = np.random.default_rng(seed), np.cumsum(p), 0

    def _move(self, i: int, at, g: np.ndarray) -> None:
        self.squares[i][at] += g * g
        self.par[i][at] -= RATE * g / np.sqrt(self.squares[i][at])

    def batch(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        """g, h and w are the classes of tokens: two before, one before, and their own."""
        r, c, d, q, b = self.par
        n = len(w)
        drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), len(b) - 1)
        rh, rg = r[h], r[g]
        x = rh @ c + rg @ d
        hit = 1 / (1 + np.exp(np.einsum("ij,ij->i", x, q[w]) + b[w] - self.log_noise[w]))  # how far from certain that it is data
        miss = 1 / (1 + np.exp(-(x @ q[drawn].T + b[drawn] - self.log_noise[drawn])))
        hit, miss = (-hit / n).astype(np.float32), (miss / n).astype(np.float32)
        gx = hit[:, None] * q[w] + miss @ q[drawn]
        scale = np.float32(n) ** 0.5  # steps are adapted to a batch's sums, not its means
        where, sums = _row_sums(np.concatenate([w, drawn]), np.concatenate([hit[:, None] * x, miss.T @ x]))
        at_b, of_b = _row_sums(np.concatenate([w, drawn]), np.concatenate([hit, miss.sum(0)]))
        at_r, of_r = _row_sums(np.concatenate([h, g]), np.concatenate([gx @ c.T, gx @ d.T]))
        gc, gd = rh.T @ gx, rg.T @ gx
        for i, (at, grad) in enumerate(((at_r, of_r), (slice(None), gc), (slice(None), gd), (where, sums), (at_b, of_b))):
            self._move(i, at, grad * scale)
        self.tokens += n


def train_tokens(train: DataFrame, head, par: Parameters, p: np.ndarray) -> Parameters:
    """The parameters after each task has gone on over all its tokens, averaged by tokens."""
    shapes, sizes = [x.shape for x in par], [x.size for x in par]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, held, n = Trainer(par, p, TaskContext.get().partitionId()), [], 0
        for b in pieces(batches):
            h, tail, first = words_of(b.column(0))
            now, before = with_ends(head.value.classes(head.value.find(h), tail), first)
            held.append(np.stack([two_before(before), before, now]))
            n += len(now)
            if n >= BATCH:
                x = np.concatenate(held, axis=1)
                for at in range(0, n - n % BATCH, BATCH):
                    t.batch(*x[:, at : at + BATCH])
                held, n = [x[:, n - n % BATCH :]], n % BATCH
        if n:
            t.batch(*np.concatenate(held, axis=1))
        if t.tokens:
            flat = np.concatenate([x.ravel() for x in t.par]).astype(np.float64) * t.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(np.append(flat, float(t.tokens)))], ["i", "x"])

    got = train.select("text").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow().sort_by("i")
    x = got["x"].to_numpy()
    if not len(x):
        return par
    parts = np.split((x[:-1] / x[-1]).astype(np.float32), np.cumsum(sizes)[:-1])
    return [v.reshape(s) for v, s in zip(parts, shapes, strict=True)]


class Tables:
    """What gives normalised natural log-probabilities: near[h, w] + far[g, w] - norm[g, h]."""

    def __init__(self, par: Parameters) -> None:
        r, c, d, q, b = (x.astype(np.float32) for x in par)
        self.near, self.far = (r @ c) @ q.T + b, (r @ d) @ q.T
        top = self.near.max(1) + self.far.max()  # no exponent overflows
        self.norm = np.empty((CLASSES, CLASSES), np.float32)
        for h in range(CLASSES):
            self.norm[:, h] = np.log(np.exp(self.far + (self.near[h] - top[h])).sum(1, dtype=np.float64)) + top[h]

    def log_p(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.near[h, w].astype(np.float64) + self.far[g, w] - self.norm[g, h]


class Model:
    """What every task gets: the frequent words, the model's tables, each tail class's mass, the base's total."""

    def __init__(self, head: Head, tables: Tables, mass: np.ndarray, tokens: int, kinds: int, ends: int) -> None:
        self.head, self.tables, self.mass = head, tables, mass
        self.tokens, self.kinds, self.ends = tokens, kinds, ends

    def base_total(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.kinds + 1)))


def fit(train: DataFrame, counts: DataFrame) -> Model:
    """Counts and trains over all of ``train``; ``counts`` is its table of word counts."""
    sc = train.sparkSession.sparkContext
    total = counts.agg(F.sum("c"), F.count("*")).first()
    ends = train.count()
    top = most_frequent(counts, "c", HEAD).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    head = Head(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["k"].to_numpy().astype(np.int64))
    shared = sc.broadcast(head)
    pairs = np.zeros(CLASSES * CLASSES)
    got = pair_counts(train, shared).toArrow()
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    mass = np.full(CLASSES, ADD)
    in_class = counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    mass[in_class["k"].to_numpy()] += in_class["c"].to_numpy() + ADD * in_class["n"].to_numpy()
    np.subtract.at(mass, top["k"].to_numpy()[:SINGLE], top["c"].to_numpy()[:SINGLE] + ADD)  # they are classes of their own
    mass = np.maximum(mass, ADD)
    pairs = pairs.reshape(CLASSES, CLASSES)
    p = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    return Model(head, Tables(train_tokens(train, shared, train_pairs(pairs), p)), mass, int(total[0] or 0) + ends, int(total[1]) + (ends > 0), ends)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<h:long,n:long>>"


def score_rows(docs: DataFrame, model) -> DataFrame:
    """Per text, what the frequent words and the model give; ``rare`` has the other words, whose counts are not known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row, m = TaskContext.get().partitionId(), 0, model.value
        log_mass, log_c = np.log10(m.mass), np.log10(m.head.c + ADD)
        for b in pieces(batches):
            h, tail, first = words_of(b.column(1))
            n = len(b)
            at = m.head.find(h)
            cls = m.head.classes(at, tail)
            now, before = with_ends(cls, first)
            text = np.repeat(np.arange(n), np.diff(first))
            token_text = np.repeat(np.arange(n), np.diff(first) + 1)
            known = at >= 0
            in_head = np.where(known, log_c[at], 0.0) if len(log_c) else np.zeros(len(at))
            in_tail = cls > END
            add = lambda of, x: np.bincount(of, x, n)
            base = add(text, in_head) + np.log10(m.ends + ADD) - (np.diff(first) + 1) * m.base_total()
            score = add(token_text, m.tables.log_p(two_before(before), before, now) / np.log(10)) + add(text, np.where(in_tail, in_head - log_mass[cls], 0.0))
            other = np.flatnonzero(~known)
            pair = np.lexsort((h[other], text[other]))
            t, x = text[other][pair], h[other][pair]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
            at_new = np.flatnonzero(new)
            times = np.diff(np.append(at_new, len(t)))
            offs = np.searchsorted(t[at_new], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(x[at_new].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array((task << 40) + row + np.arange(n)), b.column(0), b.column(2), pa.array((np.diff(first) + 1).astype(np.int64)), pa.array((add(text, known) + (m.ends > 0)).astype(np.int64)), pa.array(base), pa.array(score), rare],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )
            row += n

    return docs.mapInArrow(run, SCORED)


def score(df: DataFrame) -> DataFrame:
    """Fits on the folds that aren't held out and scores all rows."""
    docs = split(df)
    train = docs.filter(~F.col("held_out"))
    scratch = Scratch(df.sparkSession)
    counts = scratch.written(word_counts(train), "word-counts")
    model = fit(train, counts)
    rows = scratch.written(score_rows(docs, df.sparkSession.sparkContext.broadcast(model)), "scored")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.n")
    met = rare.join(counts.select("h", "c"), "h", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return (
        rows.drop("rare")
        .join(sums, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
