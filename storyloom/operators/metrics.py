"""Metrics of triples and profiles, as one-row or one-row-per-key DataFrames; values are unrounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.operators.tables import written
from storyloom.schemas import TRAITS

#: Lower bounds of the confidence bins.
BINS = (0.0, 0.5, 0.7, 0.85, 0.95)


def triple_stats(t: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return t.agg(F.count("*").alias("n_triples"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.count_distinct("relation").alias("n_relations"))


def top_relations(t: DataFrame, n: int = 10) -> DataFrame:
    """By count; of equals the first seen."""
    return t.groupBy("relation").agg(F.count("*").alias("n"), F.min("ord").alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def evidence_quality(t: DataFrame) -> DataFrame:
    text = F.nullif(F.col("evidence_span.text"), F.lit(""))
    n = F.greatest(F.count("*"), F.lit(1))
    return t.agg((F.count(text) / n).alias("coverage"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("avg_length"), F.coalesce(F.try_divide(F.count_distinct(F.left(text, F.lit(100))).cast("double"), F.count(text).cast("double")), F.lit(0.0)).alias("diversity"))


def confidence_distribution(t: DataFrame) -> DataFrame:
    """All five bins, and the population's deviation."""
    c = F.coalesce("confidence", F.lit(0.0))
    bins = [F.count_if((c >= lo) & (c < hi) if hi else c >= lo).alias(f"bin_{i}") for i, (lo, hi) in enumerate(zip(BINS, (*BINS[1:], None), strict=True))]
    return t.agg(*bins, F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))


def relation_diversity(t: DataFrame) -> DataFrame:
    """Shannon entropy in bits, normalised by that of equal counts (0 for one relation), and the Gini coefficient of the counts.

    The counts of a vocabulary meet in one task; their number doesn't grow with the triples.
    """
    n = t.groupBy("relation").agg(F.count("*").cast("double").alias("c"))
    w = W.orderBy("c", "relation")
    x = n.withColumn("i", F.row_number().over(w).cast("double")).withColumn("total", F.sum("c").over(W.partitionBy()))
    p = F.col("c") / F.col("total")
    out = x.agg(F.count("*").alias("k"), F.sum(-p * F.log2(p)).alias("entropy"), F.sum(F.col("i") * F.col("c")).alias("ic"), F.max("total").alias("total"))
    k = F.col("k").cast("double")
    return out.select(
        F.col("k").alias("n_relations"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.when(F.col("k") > 1, F.col("entropy") / F.log2(k)).otherwise(0.0).alias("normalized_entropy"),
        F.coalesce(F.lit(2.0) * F.col("ic") / (k * F.col("total")) - (k + 1) / k, F.lit(0.0)).alias("gini"),
    )


def personality_stats(p: DataFrame) -> DataFrame:
    """Mean score of each of the five traits, 0 where there is none."""
    t = p.select(F.explode("traits").alias("t")).select(F.lower("t.trait_name").alias("trait_name"), "t.score")
    five = p.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TRAITS))).alias("trait_name"))
    return five.join(t.groupBy("trait_name").agg(F.avg("score").alias("s")), "trait_name", "left").select("trait_name", F.coalesce("s", F.lit(0.0)).alias("avg_score"))


def personality_quality(p: DataFrame) -> DataFrame:
    """Spans a trait, share of profiles with five distinct traits, and the mean deviation of confidence within profiles of two traits or more."""
    mean = F.aggregate("traits", F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size("traits")
    x = p.select(F.size("traits").alias("k"), F.aggregate("traits", F.lit(0), lambda a, t: a + F.size(t["evidence_spans"])).alias("spans"), F.size(F.array_distinct(F.transform("traits", lambda t: F.lower(t["trait_name"])))).alias("kinds"), "traits", mean.alias("mean"))
    var = F.aggregate("traits", F.lit(0.0), lambda a, t: a + (t["confidence"] - F.col("mean")) * (t["confidence"] - F.col("mean"))) / F.col("k")
    x = x.withColumn("std", F.when(F.col("k") >= 2, F.sqrt(var)))
    d = lambda c: c.cast("double")
    return x.agg(F.count("*").alias("n_profiles"), F.try_divide(d(F.sum("spans")), d(F.sum("k"))).alias("spans_per_trait"), F.try_divide(d(F.count_if(F.col("kinds") == 5)), d(F.count("*"))).alias("complete_share"), F.avg("std").alias("confidence_std"))


def as_rows(section: str, one_row: DataFrame) -> DataFrame:
    """(section, metric, value) of a one-row DataFrame."""
    cols = [c for c, kind in one_row.dtypes if kind in ("double", "bigint", "int")]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols))
    return one_row.select(F.lit(section).alias("section"), F.inline(pairs))


def graph_quality(edge: DataFrame) -> list[DataFrame]:
    """One-row DataFrames: components, clustering over all nodes, assortativity, and paths in the largest component."""
    from storyloom.operators import graph

    label = graph.components(edge)
    return [
        label.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("n_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component")),
        graph.clustering(edge).agg(F.avg("clustering").alias("avg_clustering")),
        graph.assortativity(edge),
        graph.path_measures(edge, label),
    ]


def evaluated(triples: DataFrame | None, profiles: DataFrame | None, edge: DataFrame | None, node: DataFrame | None = None, top: int = 10) -> DataFrame | None:
    """(section, metric, value) of what there is; None if there is nothing. Lists, of relations, traits and most connected nodes (with
    ``node``), have a row for each of their members. What comes is written once, as every section reads it."""
    from storyloom.operators import graph

    once = lambda df, name, cols: None if df is None else written(df.select(*cols), name)
    triples = once(triples, "triples", ["ord", "relation", "confidence", "evidence_span"])
    profiles, edge = once(profiles, "profiles", ["traits"]), once(edge, "edges", ["src", "dst"])

    parts = []
    listed = lambda section, df, name, value: df.select(F.lit(section).alias("section"), F.col(name).alias("metric"), F.col(value).cast("double").alias("value"))
    if triples is not None:
        one_row = [("triples", triple_stats(triples)), ("evidence", evidence_quality(triples)), ("confidence", confidence_distribution(triples)), ("relations", relation_diversity(triples))]
        parts += [as_rows(*x) for x in one_row] + [listed("top_relations", top_relations(triples, top), "relation", "n")]
    if profiles is not None:
        parts += [as_rows("personality", personality_quality(profiles)), listed("personality_stats", personality_stats(profiles), "trait_name", "avg_score")]
    if edge is not None:
        parts += [as_rows("graph", graph.totals(edge)), *(as_rows("graph_quality", x) for x in graph_quality(edge))]
        if node is not None:
            parts += [listed("most_connected", graph.top_nodes(edge, node, top), "id", "degree")]
    out = None
    for rows in parts:
        out = rows if out is None else out.unionByName(rows)
    return out


def scored(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of found (s, r, o) as sets; 0 where a denominator is."""
    key = ["subject", "relation", "object"]
    f, t = found.select(*key).distinct().withColumn("f", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    n = f.join(t, key, "full").agg(F.count("f").cast("double").alias("nf"), F.count("t").cast("double").alias("nt"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).cast("double").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "nf"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "nt"), F.lit(0.0))
    return n.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def trait_error(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute error over (person_name, trait_name) that both have."""
    return found.join(truth.withColumnRenamed("score", "true_score"), ["person_name", "trait_name"]).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("true_score"))).alias("mae"))
