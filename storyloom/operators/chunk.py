"""Chapters and greedy chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import strip

#: How a chapter's line begins, in any case; what follows the numeral is free.
HEADING = r"(?iU)^(chapter\s+([ivxlcdm]+|\d+)|book\s+([ivxlcdm]+|\d+)|part\s+([ivxlcdm]+|\d+)|\d+\.\s+[a-z])"


def chapter_starts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chapter, start): lines that begin a chapter and where they stand."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    w = W.partitionBy(key).orderBy("line")
    at = F.coalesce(F.sum(F.length("s") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hits = lines.withColumn("start", at).filter(strip(F.col("s")).rlike(HEADING))
    return hits.select(key, F.row_number().over(w).alias("chapter"), F.col("start").cast("long").alias("start"))


def by_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chapter, start, end, text) from each chapter's line to the next; what stands before the first is dropped."""
    starts = chapter_starts(docs, key, text).join(docs.select(key, F.col(text).alias("_t")), key)
    end = F.lead("start").over(W.partitionBy(key).orderBy("chapter"))
    out = starts.withColumn("end", F.coalesce(end, F.length("_t").cast("long")))
    return out.select(key, "chapter", "start", "end", strip(F.expr("substring(_t, cast(start + 1 as int), cast(end - start as int))")).alias("text"))


def cuts(text: str, least: int, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each greedy chunk: it ends at the last empty line, else after the last sentence, beyond ``least`` characters, else at ``most``."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + most, n)
        if end < n:
            floor = start + least
            at = text.rfind("\n\n", floor, end)
            if at > floor:
                end = at
            else:
                at = max(text.rfind(mark, floor, end) for mark in (". ", "! ", "? "))
                if at > floor:
                    end = at + 1
        yield start, end
        if end >= n:
            return
        start = end - overlap


def by_length(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1200, most: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, start, end, text): one text at a time in Arrow batches, as each cut depends on the one before."""
    if not overlap < least <= most:
        raise ValueError("overlap < least <= most is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                for s, e in cuts(t or "", least, most, overlap):
                    if body := t[s:e].strip():
                        rows.append((k, n, s, e, body))
                        n += 1
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (b.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "chunk_index", "start", "end", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, chunk_index long, start long, end long, text string").withColumnRenamed("key", key)


def split_text(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chapters: int = 3, **sizes) -> DataFrame:
    """Chapters where there are at least three, else chunks; ``method`` says which."""
    many = chapter_starts(docs, key, text).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_chapters).select(key)
    w = W.partitionBy(key).orderBy("chapter")
    chapters = by_chapters(docs.join(many, key, "left_semi"), key, text).filter("text <> ''").withColumn("chunk_index", F.row_number().over(w).cast("long") - 1)
    chunks = by_length(docs.join(many, key, "left_anti"), key, text, **sizes).withColumn("chapter", F.lit(None).cast("int"))
    cols = [key, "chapter", "chunk_index", "start", "end", "text"]
    return chapters.select(*cols).unionByName(chunks.select(*cols)).withColumn("method", F.when(F.col("chapter").isNotNull(), "chapter").otherwise("length"))
