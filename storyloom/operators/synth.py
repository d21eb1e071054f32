"""Synthetic stories with known triples and profiles: the same seed gives the same rows, however they are dealt out.

A world is drawn from a seed: people, places, houses, works and feasts get names from lists of parts,
each person some facts with relations of the vocabulary, and a score for each trait.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.schemas import PERSON_RELATIONS, RELATIONS, TRAITS

_GIVEN = ("Tilda", "Bram", "Ysolt", "Corvin", "Neva", "Odo", "Petra", "Quill")
_FAMILY = ("Ashgrove", "Fennick", "Wexley", "Orrin", "Sorrel", "Tansy", "Pellow", "Marlow")
#: What a relation's object is, by the two parts of its name; the relations not named here lead to works.
_THINGS = {
    "place": (("Cinder", "Larch", "Glass", "Mossy"), ("Weir", "Orchard", "Hollow", "Stairs")),
    "house": (("Copper", "Night", "Paper", "Winter"), ("Ferrymen", "Clockwrights", "Glaziers")),
    "feast": (("Frost", "Kite", "Ember"), ("Regatta", "Market", "Vigil")),
    "work": (("Silver", "Hidden", "Folding", "Restless"), ("Orrery", "Almanac", "Lighthouse", "Loom")),
}
_LEADS_TO = {"LOCATED_IN": "place", "LOCATION": "place", "WORKS_FOR": "house", "MEMBER_OF": "house", "ORGANIZATION": "house", "LEADS": "house", "PARTICIPATES_IN": "feast", "EVENT": "feast"}

#: Sentences by relation; each can be read back. ``None`` is for all others.
SAID = {
    "KNOWS": ("{subj} recognised the voice of {obj} at once.", "Letters went back and forth from {subj} to {obj}."),
    "FAMILY_OF": ("{subj} grew up under one roof with {obj}.", "The same grandmother had raised {subj} and also {obj}."),
    "FRIENDS_WITH": ("{subj} saved the last pear for {obj}.", "Nobody made {subj} laugh as easily as {obj}."),
    "ENEMY_OF": ("{subj} crossed the street to avoid {obj}.", "An old quarrel set {subj} against {obj}."),
    "LOVES": ("{subj} kept a lock of hair cut from {obj}.", "All winter {subj} wrote verses about {obj}."),
    "HATES": ("{subj} could not bear the name of {obj}.", "Bitterness filled {subj} at the sight of {obj}."),
    "LOCATED_IN": ("{subj} rented two rooms near {obj}.", "You could find {subj} any evening by {obj}."),
    "WORKS_FOR": ("{subj} drew wages from the {obj}.", "Six days of seven {subj} served the {obj}."),
    "MEMBER_OF": ("{subj} wore the badge of the {obj}.", "The rolls listed {subj} among the {obj}."),
    "CREATED": ("{subj} finished building the {obj}.", "It took {subj} nine years to invent the {obj}."),
    None: ("{subj} was tied by {relation} to {obj}.", "The records join {subj} by {relation} with {obj}."),
}
#: What shows much and little of a trait.
SHOWN = {
    "openness": (
        ("{char} tried the strange fruit before anyone else.", "{char} asked what lay beyond the maps.", "{char} spent the morning sketching clouds."),
        ("{char} ordered the usual soup.", "{char} saw no use in new songs.", "{char} distrusted any road not walked before."),
    ),
    "conscientiousness": (
        ("{char} counted the coins twice and wrote the sum down.", "{char} arrived before the doors were opened.", "{char} sharpened every tool before putting it back."),
        ("{char} lost the key again.", "{char} left the work half done.", "{char} forgot what had been promised."),
    ),
    "extraversion": (
        ("{char} greeted the whole tavern by name.", "{char} climbed on a table to tell the story.", "{char} was the last to leave the dance."),
        ("{char} took the seat in the corner.", "{char} answered with a nod.", "{char} waited until the crowd had gone."),
    ),
    "agreeableness": (
        ("{char} shared the bread without being asked.", "{char} listened until the child stopped crying.", "{char} forgave the debt."),
        ("{char} mocked the stammering clerk.", "{char} refused to give way on the stairs.", "{char} blamed the others."),
    ),
    "neuroticism": (
        ("{char} lay awake over a careless word.", "{char} startled at each knock.", "{char} paced until the lamp burnt out."),
        ("{char} whistled while the roof shook.", "{char} slept soundly before the trial.", "{char} shrugged at the bad news."),
    ),
}
#: Scores that stand for much and for little.
LEVELS = (0.8, 0.2)
_BETWEEN = ("Rain ran down the gutters.", "Somewhere a pump creaked.", "The kettle had gone cold.", "Snow lay on the sills.")

PASSAGE = "passage_id string, book_id string, title string, chunk_index int, text string, triples array<struct<subject:string,relation:string,object:string,confidence:double>>, featured array<string>"


@dataclass(frozen=True)
class World:
    people: dict[str, dict[str, float]]  # scores by trait
    facts: tuple[tuple[str, str, str], ...]


@cache
def world(seed: int = 0, people: int = 7, facts_each: int = 4) -> World:
    rng = random.Random(f"world {seed}")
    cast = [f"{g} {f}" for g, f in zip(rng.sample(_GIVEN, people), rng.sample(_FAMILY, people), strict=True)]
    known = []
    for person in cast:
        for relation in rng.sample(RELATIONS, facts_each):
            if relation in PERSON_RELATIONS:
                other = rng.choice([c for c in cast if c != person])
            else:
                other = " ".join(map(rng.choice, _THINGS[_LEADS_TO.get(relation, "work")]))
            known.append((person, relation, other))
    return World({c: {t: rng.randint(1, 19) / 20 for t in TRAITS} for c in cast}, tuple(dict.fromkeys(known)))


def sentence(rng: random.Random, fact: tuple[str, str, str]) -> str:
    subj, relation, obj = fact
    return rng.choice(SAID.get(relation, SAID[None])).format(subj=subj, obj=obj, relation=relation.lower().replace("_", " "))


def passage(seed: int, i: int, least: int, most: int) -> dict:
    """One story: what two of the cast did, in shuffled order, padded to the least length and cut at the most."""
    w, rng = world(seed), random.Random(f"passage {seed} {i}")
    cast = rng.sample(list(w.people), 2)
    told = [f for f in w.facts if f[0] in cast and rng.random() < 0.6]
    lines = [sentence(rng, f) for f in told]
    for c in cast:
        for t in rng.sample(TRAITS, 3):
            lines.append(rng.choice(SHOWN[t][w.people[c][t] < 0.5]).format(char=c))
    rng.shuffle(lines)
    while len(" ".join(lines)) < least:
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(_BETWEEN))
    text = " ".join(lines)
    facts_ = [{"subject": s, "relation": r, "object": o, "confidence": 1.0} for s, r, o in told]
    return {"passage_id": f"synthetic_{i:03d}", "book_id": "synthetic", "title": "Synthetic", "chunk_index": i, "text": text if len(text) <= most else text[:most] + "...", "triples": facts_, "featured": cast}


def passages(spark: SparkSession, n: int = 50, seed: int = 0, least: int = 800, most: int = 1500) -> DataFrame:
    fact = pa.struct([("subject", pa.string()), ("relation", pa.string()), ("object", pa.string()), ("confidence", pa.float64())])
    kinds = {"passage_id": pa.string(), "book_id": pa.string(), "title": pa.string(), "chunk_index": pa.int32(), "text": pa.string(), "triples": pa.list_(fact), "featured": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([passage(seed, i, least, most) for i in b.column(0).to_pylist()], pa.schema(list(kinds.items())))

    return spark.range(n).mapInArrow(run, PASSAGE)


def truth(spark: SparkSession, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(subject, relation, object) and (person_name, trait_name, score)."""
    w = world(seed)
    t = spark.createDataFrame(list(w.facts), "subject string, relation string, object string")
    p = spark.createDataFrame([(c, t, s) for c, scores in w.people.items() for t, s in scores.items()], "person_name string, trait_name string, score double")
    return t, p


def save(spark: SparkSession, folder: str, n: int = 50, seed: int = 0) -> None:
    """Passages and truth as JSON Lines, and one row that describes them."""
    p, w = passages(spark, n, seed), world(seed)
    t, c = truth(spark, seed)
    about = spark.createDataFrame([(n, len(w.people), len(w.facts), seed)], "n_passages int, n_characters int, n_relations int, seed int")
    for name, df in (("passages", p.select("book_id", "title", "chunk_index", "text")), ("truth_triples", t), ("truth_traits", c), ("metadata", about.coalesce(1))):
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def facts(passages_: DataFrame) -> DataFrame:
    return passages_.select("passage_id", F.inline("triples"))


def told(triples: DataFrame) -> DataFrame:
    """(book_id, chunk_index, text): one story for each ``book_id`` and ``chunk_index`` of triples, a sentence a triple, in Spark's functions."""
    words = F.lower(F.replace("relation", F.lit("_"), F.lit(" ")))
    line = F.lit(SAID[None][0])
    for field, value in (("{subj}", F.col("subject")), ("{relation}", words), ("{obj}", F.col("object"))):
        line = F.replace(line, F.lit(field), value)
    lines = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return triples.groupBy("book_id", "chunk_index").agg(F.array_join(F.transform(lines, lambda x: x["line"]), " ").alias("text"))
