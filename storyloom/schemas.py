"""Record schemas, vocabularies, and constraint checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<text:string,start:long,end:long>"
PASSAGE = "book_id string, title string, authors array<string>, source_path string, extraction_mode string, chapter int, chunk_index int, start_char int, end_char int, text string"
TRIPLE = f"subject string, relation string, object string, confidence double, evidence_span {SPAN}, source_passage_id string, book_id string"
TRAITS_TYPE = f"array<struct<trait_name:string,score:double,confidence:double,evidence_spans:array<{SPAN}>>>"
PROFILE = f"person_name string, traits {TRAITS_TYPE}, source_passage_ids array<string>, book_id string"
MAPPING = "alias string, canonical string, confidence double, evidence string"
TRACE = "timestamp string, level string, stage string, message string, metadata map<string,string>"

#: The relation vocabulary, in its order.
RELATIONS = (
    "PERSON", "LOCATION", "ORGANIZATION", "EVENT", "RELATIONSHIP", "OWNS", "WORKS_FOR", "LOCATED_IN", "PARTICIPATES_IN", "KNOWS",
    "FAMILY_OF", "FRIENDS_WITH", "ENEMY_OF", "LOVES", "HATES", "LEADS", "MEMBER_OF", "CREATED", "MENTIONED_IN",
)
#: Relations whose both ends are people, the five traits, and the polarity of relations.
PERSON_RELATIONS = ("KNOWS", "FAMILY_OF", "FRIENDS_WITH", "ENEMY_OF", "LOVES", "HATES")
TRAITS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
POSITIVE, NEGATIVE, LEADERSHIP = ("LOVES", "FRIENDS_WITH", "FAMILY_OF"), ("ENEMY_OF", "HATES"), ("LEADS", "OWNS", "CREATED")
CONFIDENCE = 0.65


def triple_violations() -> Column:
    """The constraints a triple breaks, by name."""
    span = F.col("evidence_span")
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("confidence")),
            F.when(span.isNotNull() & ~F.coalesce(span["end"] > span["start"], F.lit(False)), F.lit("span_order")),
            F.when(span.isNotNull() & (span["start"] < 0), F.lit("span_start")),
        )
    )


def profile_violations() -> Column:
    names = F.transform("traits", lambda t: F.lower(t["trait_name"]))
    return F.array_compact(F.array(F.when(~F.forall(names, lambda n: n.isin(*TRAITS)), F.lit("trait_name")), F.when(F.size(F.array_distinct(names)) != 5, F.lit("five_traits"))))


def validate(df: DataFrame, violations: Column) -> DataFrame:
    return df.withColumn("violations", violations).withColumn("valid", F.size("violations") == 0)
