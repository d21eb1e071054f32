"""GraphML and JSON graphs, in and out."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key:string,_VALUE:string>>"


def _keys(spark: SparkSession, path: str, of: str) -> list[tuple[str, str, str]]:
    rows = spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string").load(path).collect()
    return [(r["_id"], r["_attr.name"], r["_attr.type"]) for r in rows if r["_for"] == of]


def _attributes(df: DataFrame, keys: list[tuple[str, str, str]]) -> list:
    value = lambda k: F.try_element_at(F.filter("data", lambda d: d["_key"] == k), F.lit(1))["_VALUE"]
    return [value(k).cast("double" if kind == "double" else "string").alias(name) for k, name, kind in keys]


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (src, dst, key, attributes)."""
    read = spark.read.format("xml")
    n = read.option("rowTag", "node").schema(f"_id string, {_DATA}").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, {_DATA}").load(path)
    nodes = n.select(F.col("_id").alias("id"), *_attributes(n, _keys(spark, path, "node")))
    edges = e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_id").cast("long").alias("key"), *_attributes(e, _keys(spark, path, "edge")))
    return nodes, edges


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file; rows stream through the driver one partition at a time."""
    node_attr = [c for c in nodes.columns if c not in ("id", "ord")]
    edge_attr = [c for c in edges.columns if c not in ("src", "dst", "key", "ord")]
    ids = {("node", c): f"d{i}" for i, c in enumerate(node_attr)} | {("edge", c): f"d{len(node_attr) + i}" for i, c in enumerate(edge_attr)}
    kinds = {("node", c): nodes.schema[c].dataType.simpleString() for c in node_attr} | {("edge", c): edges.schema[c].dataType.simpleString() for c in edge_attr}

    def data(of: str, row, attr: list[str]) -> str:
        return "".join(f'<data key="{ids[of, c]}">{escape(str(row[c]))}</data>' for c in attr if row[c] is not None)

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for (of, c), i in ids.items():
            f.write(f'<key id="{i}" for="{of}" attr.name={quoteattr(c)} attr.type="{"double" if kinds[of, c] == "double" else "string"}"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for r in nodes.toLocalIterator():
            f.write(f"<node id={quoteattr(r['id'])}>{data('node', r, node_attr)}</node>\n")
        for r in edges.toLocalIterator():
            f.write(f'<edge id="{r["key"]}" source={quoteattr(r["src"])} target={quoteattr(r["dst"])}>{data("edge", r, edge_attr)}</edge>\n')
        f.write("</graph>\n</graphml>\n")
