"""Models behind an interface: passage to triples, entities to mappings, context to profile; with offline ones that need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import passage_id
from storyloom.operators import synth
from storyloom.schemas import SPAN, TRAITS


class Model(Protocol):
    """A prompt's values in, the model's JSON text out."""

    def __call__(self, **values: str) -> str: ...


class TemplateExtractor:
    """Reads the synthetic stories' sentences back: each template is a pattern, and a name is two capitalised words or more."""

    def __init__(self) -> None:
        name = r"[A-Z]\w+(?: [A-Z]\w+)+"
        groups = {"subj": f"(?P<s>{name})", "obj": f"(?P<o>{name})", "relation": "(?P<r>[a-z ]+?)"}
        self.patterns = []
        for relation, sentences in synth.SAID.items():
            for s in sentences:
                parts = re.split(r"\{(\w+)\}", s)  # text and field by turns
                self.patterns.append((relation, re.compile("".join(groups[x] if i % 2 else re.escape(x) for i, x in enumerate(parts)))))

    def __call__(self, passage: str = "", **_: str) -> str:
        out = []
        for relation, p in self.patterns:
            for m in p.finditer(passage):
                r = relation or m["r"].upper().replace(" ", "_")
                out.append({"subject": m["s"], "relation": r, "object": m["o"], "confidence": 0.9, "evidence_span": {"text": m[0], "start": m.start(), "end": m.end()}})
        return json.dumps({"triples": out})


class TemplateProfiler:
    """Scores a trait by the synthetic sentences that show much or little of it: the mean level of those found."""

    def __call__(self, person: str = "", context: str = "", **_: str) -> str:
        traits = []
        for t in TRAITS:
            spans, levels = [], []
            for level, sentences in zip(synth.LEVELS, synth.SHOWN[t], strict=True):
                for s in (x.format(char=person) for x in sentences):
                    found = [{"text": s, "start": m.start(), "end": m.end()} for m in re.finditer(re.escape(s), context)]
                    spans += found
                    levels += [level] * len(found)
            if spans:
                traits.append({"trait_name": t, "score": sum(levels) / len(levels), "confidence": 0.9, "evidence_spans": spans})
        return json.dumps({"person_name": person, "traits": traits})


class CaseCanonicalizer:
    """Maps spellings that differ in case only to the first of them in order."""

    def __call__(self, entities: str = "", **_: str) -> str:
        seen: dict[str, str] = {}
        out = [{"alias": e, "canonical": seen.setdefault(e.lower(), e), "confidence": 0.95} for e in sorted(json.loads(entities))]
        return json.dumps({"mappings": [m for m in out if m["alias"] != m["canonical"]]})


def answered(df: DataFrame, make: Callable[[], Model], fields: dict[str, str]) -> DataFrame:
    """The rows with ``response``: one call a row; a call that fails gives null. ``fields`` names the column of each of the prompt's values."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, response string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def ask(**values: str) -> str | None:
            try:
                return model(**values)
            except Exception:  # a failed call must not end the job
                return None

        for b in batches:
            values = {k: b.column(b.schema.get_field_index(c)).to_pylist() for k, c in fields.items()}
            said = [ask(**{k: v[i] for k, v in values.items()}) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*b.schema.names, "response"])

    return df.mapInArrow(run, schema)


_TRIPLES = f"struct<triples:array<struct<subject:string,relation:string,object:string,confidence:double,evidence_span:{SPAN}>>>"


def parsed_triples(responses: DataFrame) -> DataFrame:
    """Triples of each response, with ids; a response that is no such JSON gives none."""
    t = F.explode(F.from_json("response", _TRIPLES)["triples"])
    return responses.select(passage_id(F.col("book_id"), F.col("chunk_index")).alias("source_passage_id"), "book_id", t.alias("t")).select("t.*", "source_passage_id", "book_id")


def extract(passages: DataFrame, make: Callable[[], Model] = TemplateExtractor) -> DataFrame:
    return parsed_triples(answered(passages.select("book_id", "chunk_index", "text"), make, {"passage": "text"}))


def canonicalise(names: DataFrame, make: Callable[[], Model] = CaseCanonicalizer, batch: int = 100) -> DataFrame:
    """(alias, canonical, confidence, ord) from batches of 100 names, ordered by lower case so that spellings meet; later batches win.

    Names are ranked within hashed parts, so that no task ranks all of them; a batch never spans two parts. All spellings of a
    name have the rank of the first, so that they are in one batch, which the last name of a batch may make longer than 100.
    """
    n = names.select(F.col(names.columns[0]).alias("e")).distinct()
    part = F.pmod(F.xxhash64(F.lower("e")), F.lit(4096))
    ranked = n.withColumn("part", part).withColumn("batch", F.floor((F.rank().over(W.partitionBy("part").orderBy(F.lower("e"))) - 1) / batch))
    asked = ranked.groupBy("part", "batch").agg(F.to_json(F.sort_array(F.collect_list("e"))).alias("entities"))
    said = answered(asked, make, {"entities": "entities"})
    m = F.from_json("response", "struct<mappings:array<struct<alias:string,canonical:string,confidence:double>>>")["mappings"]
    return said.select((F.col("part") * 1_000_000 + F.col("batch")).alias("ord"), F.inline(m))


def infer_profiles(contexts: DataFrame, make: Callable[[], Model] = TemplateProfiler) -> DataFrame:
    """(person_name, traits) of (name, context)."""
    from storyloom.schemas import TRAITS_TYPE

    said = answered(contexts, make, {"person": "name", "context": "context"})
    return said.select(F.inline(F.array(F.from_json("response", f"struct<person_name:string,traits:{TRAITS_TYPE}>"))))
