"""From raw documents to packed token sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's docs. All
but the last return the columns of ``documents``; their decisions take effect.

Defined cases: a document with a null or empty text breaks the rule on length and goes in the first stage; a null in
any other column passes through all stages, a null ``doc_id`` too, and each class of near duplicates keeps exactly one row whatever its ids; of
repeated rows one is left after near duplicates; texts are never cut, however long; ties between copies go to the least
``doc_id``; empty tables give empty ones; extra columns pass through to the last stage but for names that begin with
``_quality``, ``_ld_`` or ``_near_``. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import line_dedup, near_dedup, packing, quality_rules, secrets
from storyloom.llm.common import Scratch, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in one of them."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    p = packing.pack(docs, packing.default_tokenizer())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_spans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before go when it is written."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    name, stage = STAGES[-1]
    return scratch.last(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))


#: Near duplicates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
