"""Visual encodings as projections, and a static page of a graph."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import ellipsis
from storyloom.operators import graph
from storyloom.schemas import LEADERSHIP, NEGATIVE, POSITIVE, TRAITS

#: Colours by kind of node and by polarity of relation.
NODE_COLOURS = {"person": "#8ab4f8", "location": "#81c995", "organization": "#f28b82", "event": "#fdd663", "unknown": "#9aa0a6"}
EDGE_COLOURS = {"positive": "#81c995", "negative": "#f28b82", "leadership": "#fdd663", "neutral": "#8ab4f8"}


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def bar(score: Column) -> Column:
    return F.floor(score * 100).cast("long")


def polarity(relation: Column) -> Column:
    return F.when(relation.isin(*POSITIVE), "positive").when(relation.isin(*NEGATIVE), "negative").when(relation.isin(*LEADERSHIP), "leadership").otherwise("neutral")


def _coloured(key: Column, colours: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in colours.items() for x in kv)), key), F.lit(other))


def viz_nodes(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, size, colour, avg_confidence, opacity, border, has_personality)."""
    d = graph.degrees(edge)
    most = d.agg(F.max("degree").alias("most"))
    conf = F.array_compact(F.array(*(F.col(f"trait_{t}_conf") for t in TRAITS))) if f"trait_{TRAITS[0]}_conf" in node.columns else F.array().cast("array<double>")
    x = node.join(d, "id", "left").crossJoin(F.broadcast(most)).withColumn("_c", F.when(F.col("entity_type") == "person", conf).otherwise(F.array().cast("array<double>")))  # one row
    mean = F.when(F.size("_c") > 0, F.aggregate("_c", F.lit(0.0), lambda a, c: a + c) / F.greatest(F.size("_c"), F.lit(1))).otherwise(0.8)
    x = x.withColumn("avg_confidence", mean)
    return x.select(
        "id",
        (15 + F.coalesce("degree", F.lit(0)) / F.col("most") * 40).alias("size"),
        _coloured(F.col("entity_type"), NODE_COLOURS, NODE_COLOURS["unknown"]).alias("colour"),
        "avg_confidence",
        (0.5 + 0.5 * F.col("avg_confidence")).alias("opacity"),
        F.when(F.col("avg_confidence") >= 0.8, 3).otherwise(2).cast("long").alias("border"),
        (F.size("_c") > 0).alias("has_personality"),
    )


def viz_edges(edge: DataFrame) -> DataFrame:
    """(src, dst, key, polarity, colour, width, dashed, opacity, label, title); a missing confidence is 0.5 here."""
    c = F.coalesce("confidence", F.lit(0.5))
    p = polarity(F.col("relation"))
    return edge.select("src", "dst", "key", p.alias("polarity"), _coloured(p, EDGE_COLOURS, EDGE_COLOURS["neutral"]).alias("colour"), (0.5 + 3.5 * c).alias("width"), (c < 0.7).alias("dashed"), (0.4 + 0.6 * c).alias("opacity"), F.when(c >= 0.7, F.col("relation")).otherwise("").alias("label"), ellipsis(F.col("evidence"), 150).alias("title"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:13px sans-serif;background:#202124;color:#e8eaed}}svg{{width:100vw;height:100vh}}</style>
<svg id="g" viewBox="-520 -520 1040 1040"></svg>
<script>
const nodes={nodes},edges={edges},at={{}},svg=document.getElementById("g");
nodes.forEach((n,i)=>{{const a=2.399963*i,r=500*Math.sqrt((i+1)/nodes.length);at[n.id]=[r*Math.cos(a),r*Math.sin(a)]}});
const add=(kind,attr,tip)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",kind);for(const k in attr)e.setAttribute(k,attr[k]);
const t=document.createElementNS("http://www.w3.org/2000/svg","title");t.textContent=tip;e.append(t);svg.append(e)}};
edges.forEach(e=>{{const [a,b]=at[e.src],[c,d]=at[e.dst];add("line",{{x1:a,y1:b,x2:c,y2:d,stroke:e.colour,"stroke-width":e.width/2,"stroke-opacity":e.opacity,"stroke-dasharray":e.dashed?"5 5":"none"}},e.src+" "+e.label+" "+e.dst)}});
nodes.forEach(n=>add("circle",{{cx:at[n.id][0],cy:at[n.id][1],r:n.size/6,fill:n.colour,"fill-opacity":n.opacity,stroke:"#fff","stroke-width":n.border/3}},n.id));
</script>"""


def save_html(node: DataFrame, edge: DataFrame, path: str, title: str = "graph", most: int = 20_000) -> None:
    """A page that a browser can show: the ``most`` largest nodes and of the edges between them the 10 * ``most`` of the highest confidence."""
    ns = viz_nodes(node, edge).orderBy(F.desc("size"), "id").limit(most)
    keep = ns.select("id")
    es = viz_edges(edge).join(keep, F.col("src") == F.col("id"), "left_semi").join(keep, F.col("dst") == F.col("id"), "left_semi").orderBy(F.desc("width"), "src", "dst", "key").limit(10 * most)
    rows = lambda df: json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=title.replace("<", ""), nodes=rows(ns), edges=rows(es)))
