"""Passages as a stream of files: the stateless stages, once for each new file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import model
from storyloom.schemas import PASSAGE


def passage_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PASSAGE).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.json*").json(folder)


def triple_stream(passages: DataFrame, make: Callable[[], model.Model] = model.TemplateExtractor) -> DataFrame:
    return model.extract(passages, make)


def write_triples(triples: DataFrame, out: str, checkpoint: str):
    """Appends each batch as Parquet; a restart goes on where the checkpoint ends."""
    return triples.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count("*").alias("n"))
