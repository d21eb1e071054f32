"""Canonical names of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.schemas import CONFIDENCE, PERSON_RELATIONS

#: Names that are no characters, and pronouns.
NON_CHARACTERS = (
    "sun", "moons", "moon", "shai-hulud", "sandworm", "chakobsa", "bene gesserit way", "these people", "mentat", "fremen", "fremen woman",
    "sardaukar", "guild", "crysknife", "mother", "my mother", "his mother", "natives", "royal blood", "bene gesserit", "house atreides",
)
PRONOUNS = ("he", "she", "they", "him", "her", "them", "it", "this", "that")


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


def canonicalised(triples: DataFrame, mapping: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Subject and object looked up once each (not onwards); the last of an alias's rows counts. Spark broadcasts the mapping where it is small."""
    m = mapping.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    if "ord" in m.columns:
        m = m.groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical"))
    m = m.select("alias", "canonical")
    out = triples
    for end in ("subject", "object"):
        out = out.join(m.select(F.col("alias").alias(end), F.col("canonical").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.select(*triples.columns)


def case_mapping(triples: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(alias, canonical) of entities that are spelt in several cases: the manual name, else the longest, most frequent, first spelling."""
    seen = triples.select(F.explode(F.array("subject", "object")).alias("alias")).groupBy("alias").agg(F.count("*").alias("n")).withColumn("low", F.lower("alias"))
    group = seen.groupBy("low").agg(F.count("*").alias("variants"), F.min(F.struct(-F.length("alias"), -F.col("n"), "alias"))["alias"].alias("canonical"))
    out = seen.join(group.filter("variants >= 2"), "low")
    if manual is not None:
        out = out.join(manual.select(F.lower("alias").alias("low"), F.col("canonical").alias("_by_hand")), "low", "left").withColumn("canonical", F.coalesce("_by_hand", "canonical"))
    return out.select("alias", "canonical")


def merged_profiles(profiles: DataFrame, mapping: DataFrame, order: str = "ord") -> DataFrame:
    """One profile for each canonical name: of each trait the most confident, the first of equals; all passage ids, sorted."""
    p = profiles.join(mapping.select(F.col("alias").alias("person_name"), F.col("canonical").alias("_to")), "person_name", "left").withColumn("name", F.coalesce("_to", "person_name"))
    t = p.select("name", order, F.posexplode("traits").alias("at", "t"))
    w = W.partitionBy("name", "t.trait_name").orderBy(F.desc("t.confidence"), order, "at")
    best = t.withColumn("_n", F.row_number().over(w)).filter("_n = 1").groupBy("name").agg(F.sort_array(F.collect_list("t")).alias("traits"))
    rest = p.groupBy("name").agg(F.min_by("person_name", order).alias("original_name"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_passage_ids")))).alias("source_passage_ids"))
    return rest.join(best, "name").select(F.col("name").alias("person_name"), "original_name", "traits", "source_passage_ids")


def characters_only(profiles: DataFrame) -> DataFrame:
    return profiles.filter(~F.lower("person_name").isin(*NON_CHARACTERS, *PRONOUNS))


def people(triples: DataFrame) -> DataFrame:
    return entities(triples.filter(F.col("relation").isin(*PERSON_RELATIONS)))


def within(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples whose both ends are among the names."""
    n = names.select(F.col(names.columns[0]).alias("_name")).distinct()
    return triples.join(n, F.col("subject") == F.col("_name"), "left_semi").join(n, F.col("object") == F.col("_name"), "left_semi")
