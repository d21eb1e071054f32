"""JSON Lines and JSON, in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Blank lines are skipped, a malformed line fails the job; no schema is inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_books(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of one folder, with the name of each row's file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder).withColumn("source_file", F.col("_metadata.file_name"))


def iter_jsonl(spark: SparkSession, path: str, schema: str) -> Iterator[dict[str, Any]]:
    """One row at a time on the driver; partitions come one after the other."""
    return (r.asDict(recursive=True) for r in load_jsonl(spark, path, schema).toLocalIterator())


def discover(spark: SparkSession, folder: str, pattern: str = "*.jsonl", deep: bool = False) -> list[str]:
    """Paths of the files of a folder that any store of Spark's holds, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(folder)
    return sorted(r["path"] for r in files.select("path").collect())


def load_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def save_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Overwrites; nulls are written, too."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_json(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


def load_prompt(folder: str, name: str) -> str:
    path = Path(folder, f"{name}.txt")
    if not path.exists():
        raise FileNotFoundError(f"no template {path}")
    return path.read_text(encoding="utf-8")
