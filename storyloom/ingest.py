"""From a folder of PDF files to passages, manifests and a run log; files that are unchanged are skipped."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from storyloom.operators import ingest as I
from storyloom.operators.tables import written
from storyloom.sources import jsonl, pdf

_MANIFEST = "book_id string, title string, authors array<string>, year int, source_path string, ingested_at string, extraction_mode string, split_method string, num_chunks long, pdf_sha256 string, cleaned_text_sha256 string, cleaned_text_length long, notes string"


def run(spark: SparkSession, pdf_root: str, out_root: str, ocr: str = "auto", only_mode: str | None = None, readers: dict[str, pdf.Reader] | None = None, **sizes: int) -> dict:
    """``out_root`` gets text/ (Parquet), jsonl/ (one folder a book), metadata/manifests (JSON Lines) and the log of this run. Returns the log."""
    began = datetime.now(UTC)
    files = pdf.discover_pdfs(spark, pdf_root)
    if only_mode:
        first = pdf.pages(files, {"text": (readers or {}).get("text", pdf.text_reader)})
        types = pdf.pdf_types(first)
        files = files.join(types, "path", "left").filter(F.coalesce("pdf_type", F.lit("ocr")) == only_mode).drop("pdf_type")
    out, made = Path(out_root), Path(out_root, "metadata", "manifests")
    old = written(jsonl.load_jsonl(spark, str(made), _MANIFEST), "manifests") if made.exists() else spark.createDataFrame([], _MANIFEST)
    outputs = None
    if out.joinpath("jsonl").exists() and out.joinpath("text").exists():
        have = [p.name.partition("=")[2] for p in out.joinpath("jsonl").glob("book_id=*")]
        texts = spark.read.parquet(str(out / "text")).select(F.col("source_path").alias("path"), F.lit(1).alias("n"))
        books = old.join(spark.createDataFrame([(b,) for b in have], "book_id string"), "book_id", "left_semi").select(F.col("source_path").alias("path"), F.lit(1).alias("n"))
        outputs = texts.distinct().union(books)
    else:
        old = old.limit(0)
    todo = I.to_process(files, old, outputs)
    pages = written(pdf.extracted(todo, ocr, **(readers or {})), "pages")
    books = written(I.books(pdf.book_texts(pages)), "books")
    parts = I.passages(books, **sizes)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    parts.write.mode("overwrite").partitionBy("book_id").option("ignoreNullFields", "false").json(str(out / "jsonl"))
    books.write.mode("append").parquet(str(out / "text"))
    new = I.manifests(books, parts, todo)
    all_manifests = written(old.join(new, "book_id", "left_anti").unionByName(new.select(*old.columns)), "manifests")
    jsonl.save_jsonl(all_manifests, str(made))
    status = files.select("path").join(todo.select(F.col("path").alias("_todo")), F.col("path") == F.col("_todo"), "left").join(books.select(F.col("source_path").alias("_done")), F.col("path") == F.col("_done"), "left")
    counts = I.status_counts(status.select(F.when(F.col("_todo").isNull(), "skipped").when(F.col("_done").isNull(), "failed").otherwise("success").alias("status"))).first().asDict()
    log = {"timestamp": began.isoformat(), "pdf_root": pdf_root, "out_root": out_root, "total_pdfs": counts["total"], "successful": counts["succeeded"], "skipped": counts["skipped"], "failed": counts["failed"], "parameters": {"ocr_mode": ocr, "only_mode": only_mode, **sizes}}
    path = out / "metadata" / f"ingest_run_{began:%Y%m%d_%H%M%S}.json"
    path.write_text(json.dumps(log, indent=2), encoding="utf-8")
    return log
