"""Byte-level BPE encoding and decoding over a lexicon of the corpus's frequent words.

All words of all texts are counted; the ``lexicon_words`` most frequent are encoded
once and compiled, with their ids, into a minimal acyclic transducer (``lexicon``),
which workers memory-map. Words outside it are merged exactly (``bytebpe``), and a worker
remembers what it has looked up or merged. Special tokens part a text. Only texts with a character
newer than Python's Unicode tables go through the tokenizers library itself.

The lexicon only saves time: the ids do not depend on it.

Defined cases: a null text counts as the empty one and has no ids; very long words
are merged with a heap; a null ``doc_id`` stays null; repeated rows give one result
each; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.arrow import as_binary, byte_offsets, gather, pieces
from storyloom.llm.bytebpe import ByteBPE, byte_letters, known_texts, parts, spaced_word_spans, special_tokens, with_specials
from storyloom.llm.common import documents, most_frequent, shared_dir, text_of, written
from storyloom.llm.lexicon import Lexicon, compile_lexicon
from storyloom.llm.spans import WordTable

LEXICON_WORDS = 1 << 15


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_words(df: DataFrame, n: int = LEXICON_WORDS) -> list[bytes]:
    """The n most frequent words of all texts, in Spark's own functions; n bounds what the driver gets."""
    words = df.select(F.explode(F.regexp_extract_all(text_of(), F.lit(r" ?\p{L}+| ?[^\s\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    counts = written(words.filter(F.octet_length("w") <= ByteBPE.LONG).groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"), "words")
    return sorted(r["w"].encode() for r in most_frequent(counts, "n", n).select("w").collect())


def build_lexicon(df: DataFrame, tokenizer: str, n: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon, puts it into the shared folder and hands it to all executors; returns its file's name."""
    words = frequent_words(df, n)
    raw = compile_lexicon(words, *ByteBPE(tokenizer).encode(words))
    spark = df.sparkSession
    path = shared_dir(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(raw))
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_encoders: dict[tuple[str, str], TextEncoder] = {}


class TextEncoder:
    """A Python worker's encoder; it outlives a task."""

    def __init__(self, path: str, lexicon: str) -> None:
        self.path, self.bpe, self.lexicon, self.specials = path, ByteBPE(path), Lexicon(lexicon), special_tokens(path)
        self.table = WordTable(self._words)

    @staticmethod
    def of(path: str, lexicon: str) -> TextEncoder:
        return _encoders.get((path, lexicon)) or _encoders.setdefault((path, lexicon), TextEncoder(path, lexicon))

    @cached_property
    def tokenizer(self):
        """The library, loaded where a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number = self.lexicon.find(words)
        known = number >= 0
        count, ids = self.bpe.encode([w for w, k in zip(words, known.tolist(), strict=True) if not k])
        length, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        length[known], begin[known] = self.lexicon.lengths(number[known]), self.lexicon.start[number[known]]
        length[~known], begin[~known] = count, len(self.lexicon.ids) + np.cumsum(count) - count
        return length, gather(begin, length, np.concatenate([self.lexicon.ids, ids]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        inner, of, after = parts(column, self.specials)
        count, ids = self._parts(inner)
        return with_specials(count, ids, of, after, len(column))

    def _parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = byte_offsets(column)
        known = known_texts(offsets, data)
        if known.all():
            return self._simple(offsets, data)
        out, at = [], 0
        while at < len(known):  # runs of texts of either kind
            to = at + 1
            while to < len(known) and known[to] == known[at]:
                to += 1
            if known[at]:
                out.append(self._simple(offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]))
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in column.slice(at, to - at).to_pylist()], add_special_tokens=False)]
                out.append((np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _simple(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.uint32)
        starts, ends, first = spaced_word_spans(offsets, data)
        length, ids = self.table.take(data, starts, ends)
        return np.diff(np.concatenate([[0], np.cumsum(length)])[first]), ids


def encode(df: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; ids are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder.of(tokenizer, SparkFiles.get(lexicon))
        for b in pieces(batches):
            n, ids = coder.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), as_binary(np.cumsum(n), ids), pa.array(n)], ["doc_id", "ids", "n_tokens"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the vocabulary's, and the added tokens' texts."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    back = {c: b for b, c in enumerate(byte_letters())}
    out = [b""] * (1 + max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]))
    for token, i in file["model"]["vocab"].items():
        out[i] = bytes(back[c] for c in token)
    for t in file["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


class TextDecoder:
    def __init__(self, tokenizer: str) -> None:
        tokens = token_bytes(tokenizer)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each run of ids (the i-th lies between offsets i and i + 1)."""
        size = self.size[ids]
        return _texts(np.concatenate([[0], np.cumsum(size)])[offsets], gather(self.start[ids], size, self.flat))


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text of the ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TextDecoder(tokenizer)
        for b in pieces(batches, "ids"):
            offsets, data = byte_offsets(b.column(1))
            yield pa.RecordBatch.from_arrays([*b.columns, reader.decode(offsets // 4, np.frombuffer(data.tobytes(), np.uint32))], ["doc_id", "ids", "n_tokens", "decoded"])

    return df.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def _texts(at: np.ndarray, data: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    inner = at[at < len(data)]
    try:
        raw.decode()
        whole = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def round_trip(df: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """``encode`` and then ``decode`` in one Python worker a task: (doc_id, ids, n_tokens, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = TextEncoder.of(tokenizer, SparkFiles.get(lexicon)), TextDecoder(tokenizer)
        for b in pieces(batches):
            n, ids = coder.encode(b.column(1))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), as_binary(ends, ids), pa.array(n), reader.decode(np.concatenate([[0], ends]), ids)], ["doc_id", "ids", "n_tokens", "decoded"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, path = documents(spark, sf_dir), default_tokenizer()
    out = round_trip(d, path, build_lexicon(d, path))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
