"""From extracted texts to passages, manifests and logs."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import chunk


def books(texts: DataFrame) -> DataFrame:
    """(book_id, title, authors, source_path, extraction_mode, text) of (path, extraction_mode, text)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    d = T.clean(texts.withColumn("_stem", stem)).withColumn("_ta", T.title_and_author(F.col("_stem")))
    return d.select(T.slug(F.col("_stem")).alias("book_id"), F.col("_ta.title").alias("title"), F.array("_ta.author").alias("authors"), F.col("path").alias("source_path"), "extraction_mode", F.col("cleaned").alias("text"))


def passages(book: DataFrame, **sizes) -> DataFrame:
    """Chunks with their book's fields on each."""
    parts = chunk.split_text(book, "book_id", "text", **sizes)
    meta = book.select("book_id", "title", "authors", "source_path", "extraction_mode")
    return parts.join(meta, "book_id").select("book_id", "title", "authors", "source_path", "extraction_mode", "chapter", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("start").cast("int").alias("start_char"), F.col("end").cast("int").alias("end_char"), "text")


def manifests(book: DataFrame, parts: DataFrame, files: DataFrame) -> DataFrame:
    """One row a book; ``year`` and ``notes`` are the book's, if it has them."""
    n = parts.groupBy("book_id").agg(F.count("*").alias("num_chunks"), F.when(F.min_by("chapter", "chunk_index").isNotNull(), "chapters").otherwise("length").alias("split_method"))
    f = files.select(F.col("path").alias("source_path"), F.col("sha256").alias("pdf_sha256"))
    own = lambda c, kind: F.col(c) if c in book.columns else F.lit(None).cast(kind).alias(c)
    return book.join(n, "book_id", "left").join(f, "source_path", "left").select(
        "book_id", "title", "authors", own("year", "int"), "source_path", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ingested_at"), "extraction_mode",
        F.coalesce("split_method", F.lit("length")).alias("split_method"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), "pdf_sha256", F.sha2("text", 256).alias("cleaned_text_sha256"), F.length("text").alias("cleaned_text_length"), F.coalesce(own("notes", "string"), F.lit("")).alias("notes"),
    )


def to_process(files: DataFrame, manifest: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Files without a manifest, whose content has changed since, or, given the ``outputs`` that exist (path, n), fewer than two of which are there: text and passages."""
    m = manifest.select(F.col("source_path").alias("path"), F.col("pdf_sha256").alias("_old"))
    x = files.join(m, "path", "left")
    stale = F.col("_old").isNull() | (F.col("_old") != F.col("sha256"))
    if outputs is not None:
        x = x.join(outputs.groupBy("path").agg(F.sum("n").alias("_outputs")), "path", "left")
        stale = stale | (F.coalesce("_outputs", F.lit(0)) < 2)
    return x.filter(stale).drop("_old", "_outputs")


def status_counts(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(F.count_if(s == "success").alias("succeeded"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total"))


class RunLog:
    """Events as JSON Lines on the driver."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.touch()

    def log(self, level: str, stage: str, message: str, **metadata) -> None:
        event = {"timestamp": datetime.now(UTC).isoformat(), "level": level, "stage": stage, "message": message} | ({"metadata": metadata} if metadata else {})
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False, default=str) + "\n")

    @contextmanager
    def stage(self, name: str):
        """Start, end and duration; a failure is logged and raised again."""
        began = time.time()
        self.log("INFO", name, "start")
        try:
            yield self
        except Exception as e:
            self.log("ERROR", name, "failed", error=str(e), seconds=round(time.time() - began, 3))
            raise
        self.log("INFO", name, "complete", seconds=round(time.time() - began, 3))

    def summary(self, path: str, **values) -> None:
        Path(path).write_text(json.dumps({"finished_at": datetime.now(UTC).isoformat()} | values, indent=2, default=str), encoding="utf-8")
