"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.tables import Scratch, shared_dir, written

__all__ = ["Scratch", "shared_dir", "written"]

#: The white space that parts words in every operator here.
SPACES = "\t\n\x0b\f\r "
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where every character has one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def key128(text: Column, salt: str = "storyloom") -> list[Column]:
    """Two 64-bit hashes with independent seeds: together the identity of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(salt), text)]


def most_frequent(counts: DataFrame, count: str, n: int) -> DataFrame:
    """At most n rows of the highest counts, those of equal level (a 64th of an octave) all or none: no task sends its own n to the driver."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 64).cast("int")
    least, left = 1 << 30, n
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    return counts.filter(level >= least)
