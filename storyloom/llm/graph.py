"""Minima of groups and connected components where one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Scratch


def salt_of(column: str, df: DataFrame) -> Column:
    """One of as many salts as there are shuffle partitions (16 at least): a group of any size is dealt over all of them."""
    return F.pmod(F.xxhash64(F.lit("salt"), column), F.lit(max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def with_group(df: DataFrame, keys: list[str], spread: str, sums: dict[str, tuple[Column, callable]]) -> DataFrame:
    """Adds aggregates over each group of ``keys`` to all its rows. ``sums`` has, by name, the column and the function, one
    that may be applied to its own results. Parts of a group, dealt by ``spread``, are summed first and meet last."""
    rows = df.withColumn("_salt", salt_of(spread, df))
    part = rows.groupBy(*keys, "_salt").agg(*(f(c).alias(f"_p_{n}") for n, (c, f) in sums.items()))
    whole = part.groupBy(*keys).agg(*((F.sum if f is F.count else f)(f"_p_{n}").alias(n) for n, (_, f) in sums.items()))
    back = part.select(*keys, "_salt").join(whole, keys)
    return rows.join(back, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): the least node of the component of each node that has an edge.

    Each round a node takes the least label of its neighbours and then that label's own,
    so that labels jump; the rounds grow with the logarithm of the longest path. A round is
    a table in the shared folder. A hub is spread: its edges meet its label in a join that
    Spark may split, and minima are taken before they meet.
    """
    links = scratch.written(edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v"), "edges")
    label = scratch.written(links.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("class")), "labels")
    while True:
        seen = links.join(label, links["v"] == label["node"]).groupBy("u").agg(F.min("class").alias("m"))
        step = label.join(seen, label["node"] == seen["u"]).select("node", F.col("class").alias("was"), F.least("class", "m").alias("m"))
        jump = step.join(label.select(F.col("node").alias("m"), F.col("class").alias("j")), "m", "left")
        new = scratch.written(jump.select("node", "was", F.least("m", F.coalesce("j", "m")).alias("class")), "labels")
        label = new.select("node", "class")
        if new.filter("was <> class").isEmpty():
            return label
