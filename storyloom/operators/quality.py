"""Filters on triples and trait evidence, deduplication, and the quality pass over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import entity, strip
from storyloom.schemas import CONFIDENCE, RELATIONS


def confident(c: Column, threshold: float = CONFIDENCE) -> Column:
    return F.coalesce(c, F.lit(0.0)) >= threshold


def good_evidence(span: Column, least: int = 10, most: int = 500) -> Column:
    """The text's own length counts, not end - start."""
    t = span["text"]
    return F.coalesce((span["start"] < span["end"]) & F.length(t).between(least, most) & (strip(t) != ""), F.lit(False))


def proper(subject: Column, object_: Column) -> Column:
    return (subject != "") & (object_ != "") & (subject != object_)


def overlap(a: Column, b: Column, most: float = 0.3) -> Column:
    """Whether two spans share more than ``most`` of the shorter one."""
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
    return F.coalesce((shared > 0) & (shorter > 0) & (F.try_divide(shared.cast("double"), shorter.cast("double")) > most), F.lit(False))


def good_trait(trait: Column, least_spans: int = 2, least_chars: int = 50) -> Column:
    """At least two spans of 50 characters, no two of which overlap."""
    spans = F.filter(trait["evidence_spans"], lambda s: F.length(strip(s["text"])) >= least_chars)
    clash = F.exists(F.transform(spans, lambda s, i: F.exists(F.slice(spans, i + 2, F.greatest(F.size(spans) - i - 1, F.lit(0))), lambda t: overlap(s, t))), lambda x: x)
    return F.coalesce((F.size(trait["evidence_spans"]) >= least_spans) & (F.size(spans) >= least_spans) & ~clash, F.lit(False))


def good_profiles(profiles: DataFrame, threshold: float = CONFIDENCE, least_traits: int = 3) -> DataFrame:
    kept = F.filter("traits", lambda t: confident(t["confidence"], threshold) & good_trait(t))
    return profiles.withColumn("traits", kept).filter(F.size("traits") >= least_traits)


def deduplicated(triples: DataFrame) -> DataFrame:
    """One row for each (subject, relation, object): the most confident, the first of equals.

    ``max_by`` sums up before the shuffle, so that a triple of half the corpus costs one row a task.
    """
    rest = [c for c in triples.columns if c not in ("subject", "relation", "object")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ord"))).alias("_best")
    out = triples.groupBy("subject", "relation", "object").agg(best, F.min("ord").alias("first_ord"))
    return out.select("subject", "relation", "object", *(F.col(f"_best.{c}").alias(c) for c in rest), "first_ord")


def quality_pass(triples: DataFrame, threshold: float = CONFIDENCE, observation: Observation | None = None, only_known: bool = False) -> DataFrame:
    """Confidence, evidence, names, self-loops and duplicates, in this order; the counts of each pass come with the job that runs it."""
    span = F.col("evidence_span")
    sure, seen = confident(F.col("confidence"), threshold), good_evidence(span)
    t = triples
    if observation is not None:
        t = t.observe(observation, F.count(F.lit(1)).alias("initial"), F.count_if(sure).alias("confident"), F.count_if(sure & seen).alias("with_evidence"))
    t = t.filter(sure).filter(seen).withColumn("subject", entity(F.col("subject"))).withColumn("object", entity(F.col("object"))).filter(proper(F.col("subject"), F.col("object")))
    if only_known:
        t = t.filter(F.col("relation").isin(*RELATIONS))
    return deduplicated(t)


def retention(initial: int, final: int) -> str:
    return f"{100 * final / initial:.1f}%" if initial else "0.0%"


def first_per_book(passages: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("book_id").orderBy("chunk_index"))
    return passages.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")
