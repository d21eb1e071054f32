"""PDF files to text: page readers behind an interface, and which of them a file needs."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reader takes a file's bytes and gives the text of each page; it raises what it can't read.
Reader = Callable[[bytes], list[str]]


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, sha256, length) of every PDF below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), "length")


def text_reader(content: bytes) -> list[str]:
    """Embedded text, where the library for it is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def ocrmypdf_reader(content: bytes, seconds: int = 600) -> list[str]:
    with tempfile.TemporaryDirectory() as d:  # a task's own scratch, gone when it ends
        Path(d, "in.pdf").write_bytes(content)
        subprocess.run(["ocrmypdf", "--force-ocr", f"{d}/in.pdf", f"{d}/out.pdf"], check=True, timeout=seconds, capture_output=True)
        return text_reader(Path(d, "out.pdf").read_bytes())


def tesseract_reader(content: bytes, dpi: int = 300) -> list[str]:
    import pdf2image
    import pytesseract

    return [pytesseract.image_to_string(p, lang="eng") for p in pdf2image.convert_from_bytes(content, dpi=dpi)]


def pages(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(path, extraction_mode, page_no, text): each reader in turn until one gives text; a file that none can read has no rows."""
    chain = readers or {"text": text_reader, "ocr_ocrmypdf": ocrmypdf_reader, "ocr_pytesseract": tesseract_reader}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for mode, read in chain.items():
                    try:
                        got = read(content)
                    except Exception:  # the next reader's turn
                        continue
                    if any(p.strip() for p in got):
                        rows += [(path, mode, i, t) for i, t in enumerate(got)]
                        break
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "extraction_mode", "page_no", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, extraction_mode string, page_no int, text string")


def extracted(files: DataFrame, mode: str = "auto", **readers: Reader) -> DataFrame:
    """``auto`` tries text and then OCR, ``text`` text only, anything else OCR only."""
    chain = {"text": text_reader, "ocr_ocrmypdf": ocrmypdf_reader, "ocr_pytesseract": tesseract_reader} | readers
    wanted = chain if mode == "auto" else {k: v for k, v in chain.items() if (k == "text") == (mode == "text")}
    return pages(files, wanted)


def book_texts(page_rows: DataFrame) -> DataFrame:
    """(path, extraction_mode, text): pages in order, joined by line ends."""
    p = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return page_rows.groupBy("path", "extraction_mode").agg(F.array_join(F.transform(p, lambda x: x["text"]), "\n").alias("text"))


def pdf_types(page_rows: DataFrame, key: str = "path", sample: int = 5, least: int = 100) -> DataFrame:
    """(key, pdf_type): ocr where the first pages have fewer than ``least`` characters on average."""
    from storyloom.functions.text import strip

    n = F.when(F.col("page_no") < sample, F.length(strip(F.coalesce("text", F.lit("")))))
    return page_rows.groupBy(key).agg(F.when(F.avg(n) >= least, "text").otherwise("ocr").alias("pdf_type"))
