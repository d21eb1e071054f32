"""The property multigraph as two DataFrames, and what is measured on it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.operators import paths
from storyloom.operators.tables import Scratch, ranked, written
from storyloom.schemas import TRAITS

#: Links (both ways) and nodes up to which the largest component is sent to the tasks whole; the bits that a task holds twice, and the most words of 64 sources.
MOST_LINKS, MOST_NODES, TASK_BITS, MOST_WORDS = 1 << 25, 1 << 21, 1 << 30, 16
#: Rows of a step beyond that.
JOINED_ROWS = 1 << 28


def trait_columns(profiles: DataFrame, order: str = "ord") -> DataFrame:
    """(id, trait_*, trait_*_conf): the last profile of a name counts."""
    last = profiles.groupBy("person_name").agg(F.max_by("traits", order).alias("traits"))
    one = lambda t: F.try_element_at(F.filter("traits", lambda x: x["trait_name"] == t), F.lit(-1))
    return last.select(F.col("person_name").alias("id"), *(c for t in TRAITS for c in (one(t)["score"].alias(f"trait_{t}"), one(t)["confidence"].alias(f"trait_{t}_conf"))))


def nodes(triples: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(id, ord, entity_type, label, trait columns); ord is where a node was first seen."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), (2 * F.col("ord")).alias("ord")), F.struct(F.col("object").alias("id"), (2 * F.col("ord") + 1).alias("ord")))).alias("e"))
    n = ends.groupBy(F.col("e.id").alias("id")).agg(F.min("e.ord").alias("ord"))
    if profiles is None:
        return n.withColumns({"entity_type": F.lit("unknown"), "label": F.col("id")})
    t = trait_columns(profiles).withColumn("_person", F.lit(True))
    return n.join(t, "id", "left").withColumn("entity_type", F.when(F.col("_person"), "person").otherwise("unknown")).withColumn("label", F.col("id")).drop("_person")


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, key, relation, confidence, evidence, ord): parallel edges are numbered from 0."""
    w = W.partitionBy("subject", "object").orderBy("ord")
    return triples.select(F.col("subject").alias("src"), F.col("object").alias("dst"), (F.row_number().over(w) - 1).cast("long").alias("key"), "relation", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("evidence_span.text", F.lit("")).alias("evidence"), "ord")


def degrees(edge: DataFrame) -> DataFrame:
    """(id, degree): both directions, parallel edges counted, a loop twice."""
    return edge.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def totals(edge: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average and largest degree."""
    d = degrees(edge).agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"))
    n, m = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    density = F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0))
    label = F.when(density < 0.01, "very_sparse").when(density < 0.05, "sparse").when(density < 0.2, "moderate").otherwise("dense")
    return d.withColumn("density", density).withColumn("density_label", label)


def simple(edge: DataFrame) -> DataFrame:
    """(a, b), a < b: the undirected simple graph."""
    return edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edge: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """(id, component): the least id of each weakly connected component; rounds grow with the logarithm of the longest path, as labels also jump along labels.
    The result is a table, of ``keep`` where that is given. A round's table goes when the next one is written."""
    scratch, rounds = Scratch(edge.sparkSession), [Scratch(edge.sparkSession)]
    pairs = scratch.written(edge.select("src", "dst").distinct(), "pairs")
    links = scratch.written(both_ways(simple(pairs)), "links")
    first = links.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    alone = pairs.filter("src = dst").select(F.col("src").alias("id")).distinct().join(first, "id", "left_anti")
    label = rounds[0].written(first.unionByName(alone.withColumn("component", F.col("id"))), "labels")
    while True:
        seen = links.join(label, links["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(seen, label["id"] == seen["a"], "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("m"))
        jump = step.join(label.select(F.col("id").alias("m"), F.col("component").alias("j")), "m", "left")
        rounds.append(Scratch(edge.sparkSession))
        new = rounds[-1].written(jump.select("id", F.col("component").alias("was"), F.least("m", F.coalesce("j", "m")).alias("component")), "labels")
        rounds.pop(0).drop()
        label = new.select("id", "component")
        if new.filter("was <> component").isEmpty():
            scratch.drop()
            out = keep.written(label, "components") if keep else written(label, "components")
            rounds.pop().drop()
            return out


def component_sizes(edge: DataFrame) -> DataFrame:
    return components(edge).groupBy("component").agg(F.count("*").alias("size"))


def largest_component(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of the largest component, of equals that of the least name, and its (a, b) both ways."""
    edge = written(edge.select("src", "dst").distinct(), "pairs")
    label = components(edge)
    largest = label.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = written(label.join(largest, "component", "left_semi").select("id"), "inside")
    return inside, written(both_ways(simple(edge)).join(inside, F.col("a") == F.col("id"), "left_semi"), "links")


def distances(edge: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, dist) of all pairs within the largest component, by a frontier join for each step; ``sources`` limits where paths begin."""
    inside, links = largest_component(edge)
    return _distances(inside, links, sources)


def _distances(inside: DataFrame, links: DataFrame, sources: DataFrame | None) -> DataFrame:
    start = inside if sources is None else inside.join(sources.select("id"), "id", "left_semi")
    frontier = start.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("dist"))
    found = frontier = written(frontier, "paths")
    step = 0
    while not frontier.isEmpty():
        step += 1
        new = frontier.select("src", F.col("dst").alias("a")).join(links, "a").select("src", F.col("b").alias("dst")).distinct()
        frontier = written(new.join(found, ["src", "dst"], "left_anti").withColumn("dist", F.lit(step)), "paths")
        found = found.unionByName(frontier)
    return found.filter("dist > 0")


def path_measures(edge: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """One row: average and largest distance within the largest component; ``label`` has the components where they are known.

    Where that component has no more than MOST_LINKS links and MOST_NODES nodes, these are counted first, its links go to all tasks as
    numbers, and each task walks from many sources at once: a bit for each source and node, one step an OR along links.
    Beyond, the same is done by joins, for a batch of sources after the other, as all pairs would not fit any disk.
    """
    scratch = Scratch(edge.sparkSession)
    pairs = scratch.written(edge.select("src", "dst").distinct(), "pairs")
    label = components(pairs, scratch) if label is None else label
    largest = label.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = label.join(largest, "component", "left_semi").select("id", F.lit(0).alias("all"))
    number = scratch.written(ranked(inside, "all", ["id"], "n", keep=scratch).select("id", F.col("n").cast("int").alias("n")), "numbers")
    end = lambda c: number.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    links = scratch.written(simple(pairs).join(end("a"), "a").join(end("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")), "links")
    nodes, m = number.count(), 2 * links.count()
    found = _walked(links, nodes) if m <= MOST_LINKS and nodes <= MOST_NODES else _joined(links, nodes, m)
    scratch.drop()
    return found


def _measured(part: DataFrame) -> DataFrame:
    found = F.sum("pairs") > 0
    return part.agg(F.when(found, F.sum("total") / F.sum("pairs")).alias("avg_path_length"), F.when(found, F.max("most")).alias("diameter"))


def _walked(links: DataFrame, nodes: int) -> DataFrame:
    spark = links.sparkSession
    ends = links.toArrow()
    walker = paths.Walker(*paths.renumbered(*paths.neighbours(ends["a"].to_numpy(), ends["b"].to_numpy(), nodes)))
    shared = spark.sparkContext.broadcast(walker)
    size = 64 * int(max(1, min(-(-nodes // 64), TASK_BITS // 64 // max(1, nodes), MOST_WORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.walk(k * size, min(nodes, (k + 1) * size)) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["total", "pairs", "most"])

    blocks = -(-nodes // size)
    return _measured(spark.range(0, blocks, 1, max(1, min(blocks, 4096))).mapInArrow(run, "total long, pairs long, most long"))


def _joined(links: DataFrame, nodes: int, m: int) -> DataFrame:
    """By joins: a row has a node and a word of 64 sources. The tables of a step go when the next one is written, and
    a batch has as many words as keep a step's rows within JOINED_ROWS, one at least."""
    spark, out = links.sparkSession, []
    both = both_ways(links)
    batch = 64 * max(1, JOINED_ROWS // max(1, m))
    for lo in range(0, nodes, batch):
        old = Scratch(spark)
        n = F.col("id")
        far = spark.range(lo, min(nodes, lo + batch)).select(n.cast("int").alias("id"), F.floor(n / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bits"))
        far = seen = old.written(far, "far")
        step = 0
        while True:
            step += 1
            new, scratch = far.join(both, far["id"] == both["a"]).groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("bits").alias("new")), Scratch(spark)
            step_rows = seen.join(new, ["id", "word"], "full").withColumn("bits", F.coalesce("bits", F.lit(0)))
            step_rows = step_rows.withColumn("new", F.coalesce(F.col("new").bitwiseAND(F.bitwise_not("bits")), F.lit(0)))
            rows = scratch.written(step_rows.select("id", "word", F.col("bits").bitwiseOR(F.col("new")).alias("bits"), "new"), "seen")
            old.drop()
            old, seen = scratch, rows.select("id", "word", "bits")
            count = rows.agg(F.sum(F.bit_count("new").cast("long"))).first()[0]
            if not count:
                break
            far = rows.filter("new <> 0").select("id", "word", F.col("new").alias("bits"))
            out.append((count * step, count, step))
        old.drop()
    return _measured(spark.createDataFrame(out, "total long, pairs long, most long"))


def clustering(edge: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) on the simple graph. Edges run from the lesser to the greater degree, so that a hub opens few wedges."""
    s = simple(edge)
    d = both_ways(s).groupBy("a").agg(F.count("*").alias("d"))
    x = s.join(d.select("a", F.col("d").alias("da")), "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    low = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    e = x.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = e.join(e.select("u", F.col("v").alias("w")), "u").filter("v <> w").filter("v < w")
    closed = wedge.join(s, (F.col("v") == F.col("a")) & (F.col("w") == F.col("b")), "left_semi")
    t = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    every = edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    k, n = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    out = every.join(d.withColumnRenamed("a", "id"), "id", "left").join(t, "id", "left")
    return out.select("id", k.alias("degree"), n.alias("triangles"), F.coalesce(F.try_divide(2.0 * n, (k * (k - 1)).cast("double")), F.lit(0.0)).alias("clustering"))


def assortativity(edge: DataFrame) -> DataFrame:
    """One row: the correlation of the source's out-degree with the target's in-degree over all edges; null where one of them doesn't vary."""
    out_, in_ = (edge.groupBy(c).agg(F.count("*").cast("double").alias(n)) for c, n in (("src", "o"), ("dst", "i")))
    return edge.select("src", "dst").join(out_, "src").join(in_, "dst").agg(F.try_divide(F.covar_pop("o", "i"), F.stddev_pop("o") * F.stddev_pop("i")).alias("assortativity"))


def neighbourhood(edge: DataFrame, node: DataFrame, named: DataFrame) -> DataFrame:
    """Edges of the subgraph of the named nodes and those of their successors that are named or people."""
    n = named.select(F.col(named.columns[0]).alias("id")).distinct()
    near = edge.join(n, edge["src"] == n["id"], "left_semi").select(F.col("dst").alias("id")).join(node.filter("entity_type = 'person'").select("id"), "id", "left_semi")
    keep = n.union(near).distinct()
    return edge.join(keep, edge["src"] == keep["id"], "left_semi").join(keep, edge["dst"] == keep["id"], "left_semi")


def ego(edge: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges that touch a centre: two equi-joins, so that neither side need be small."""
    c = centres.select(F.col(centres.columns[0]).alias("id")).distinct()
    out = edge.join(c, edge["src"] == c["id"], "left_semi")
    return out.unionByName(edge.join(c, edge["src"] == c["id"], "left_anti").join(c, edge["dst"] == c["id"], "left_semi"))


def top_nodes(edge: DataFrame, node: DataFrame, n: int = 10) -> DataFrame:
    """By degree; of equals the first seen."""
    return degrees(edge).join(node.select("id", "ord"), "id").orderBy(F.desc("degree"), "ord").limit(n).select("id", "degree")


def exported(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the JSON export: one JSON object a node and an edge."""
    attr = [c for c in node.columns if c not in ("id", "ord")]
    ns = node.select(F.to_json(F.struct("id", F.struct(*attr).alias("attributes"))).alias("json"))
    es = edge.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("relation", "confidence", "evidence").alias("attributes"))).alias("json"))
    return ns, es
