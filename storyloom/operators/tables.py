"""Tables in the folder that the cluster shares: written instead of kept, so that a lost executor loses none of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where none is set and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.gettempdir()}/storyloom-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows written as a table and read again: lineage ends here."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that an operator writes on its way; they go when its last one is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, name))
        return written(df, name, self.paths[-1])

    def last(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.drop()
        return out

    def drop(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


def ranked(df: DataFrame, by: str, order: list[str], rank: str, total: str | None = None, keep: Scratch | None = None) -> DataFrame:
    """The rows with their rank from 0 within ``by``, in order, and how many there are: a group of any size is dealt over all tasks.

    Rows are range-partitioned by group and order and written with their part; what comes before a part in a group
    is a sum over the group's parts, of which there are no more than tasks. Pass few columns: all that come are sorted. The table is one of ``keep`` where that is given.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (keep.written if keep else written)(df.repartitionByRange(n, by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    here = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    w = W.partitionBy(by).orderBy("_part")
    before = here.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(by)).alias("_total"))
    within = F.row_number().over(W.partitionBy(by, "_part").orderBy(*order)) - 1
    out = parts.withColumn("_i", within).join(before, parts[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    more = [F.col("_total").cast("long").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_before") + F.col("_i")).cast("long").alias(rank), *more)
