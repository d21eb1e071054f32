"""From passages to an evaluated graph: the stages chained, each reading what the one before wrote to the run's folder.

A run's folder holds triples_raw.jsonl, triples_canonical.jsonl, traits_raw.jsonl, traits_final.jsonl (folders of JSON
Lines that Spark writes), graph.graphml, graph.json, graph.html, metrics.json, run_summary.json and trace.jsonl. The driver writes the
files and the executors the folders, so on a cluster it lies where both reach it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import passage_id
from storyloom.operators import entity, graph, metrics, model, profile, quality, viz
from storyloom.operators.ingest import RunLog
from storyloom.operators.tables import shared_dir
from storyloom.schemas import CONFIDENCE, MAPPING, PASSAGE, PROFILE, RELATIONS, TRIPLE
from storyloom.sources import graphml, jsonl

PROMPTS = Path(__file__).resolve().parent / "prompts"
STAGES = ("extract", "canonicalize", "qa_filters", "traits", "build_graph", "viz", "evaluate")
ARTIFACTS = {"extract": "triples_raw.jsonl", "canonicalize": "triples_canonical.jsonl", "qa_filters": "triples_canonical.jsonl", "traits": "traits_final.jsonl", "build_graph": "graph.graphml", "viz": "graph.html", "evaluate": "metrics.json"}
_TRIPLE = f"ord long, {TRIPLE}"


def _fresh() -> str:
    return f"outputs/run_{datetime.now(UTC):%Y%m%d_%H%M%S}"


@dataclass(frozen=True)
class Settings:
    """What a run reads and where it writes; the models are factories, offline ones if not given."""

    input: str
    output: str = field(default_factory=_fresh)
    confidence: float = CONFIDENCE
    max_passages: int | None = None
    model_name: str = "templates"
    extractor: Callable[[], model.Model] = model.TemplateExtractor
    canonicalizer: Callable[[], model.Model] = model.CaseCanonicalizer
    profiler: Callable[[], model.Model] = model.TemplateProfiler
    relations: tuple[str, ...] = RELATIONS

    def path(self, name: str) -> str:
        Path(self.output).mkdir(parents=True, exist_ok=True)
        return str(Path(self.output, name).absolute())

    def prompt(self, name: str) -> str:
        return jsonl.load_prompt(str(PROMPTS), name)


def _read(spark: SparkSession, s: Settings, name: str, schema: str) -> DataFrame:
    return jsonl.load_jsonl(spark, s.path(name), schema)


def _passages(spark: SparkSession, s: Settings) -> DataFrame:
    p = jsonl.load_jsonl(spark, s.input, PASSAGE) if s.input.endswith((".jsonl", ".json")) else jsonl.load_books(spark, s.input, PASSAGE, "*.json*")
    return p if s.max_passages is None else quality.first_per_book(p, s.max_passages)


def extract(spark: SparkSession, s: Settings) -> None:
    t = model.extract(_passages(spark, s), s.extractor)
    jsonl.save_jsonl(t.withColumn("ord", F.monotonically_increasing_id()), s.path("triples_raw.jsonl"))


def canonicalize(spark: SparkSession, s: Settings) -> None:
    t = _read(spark, s, "triples_raw.jsonl", _TRIPLE)
    mapping = model.canonicalise(entity.entities(t), s.canonicalizer)
    jsonl.save_jsonl(entity.canonicalised(t, mapping, s.confidence), s.path("triples_canonical.jsonl"))


def qa_filters(spark: SparkSession, s: Settings) -> None:
    """In place: the rows that pass are written aside first."""
    good = quality.quality_pass(_read(spark, s, "triples_canonical.jsonl", _TRIPLE), s.confidence, only_known=True).drop("first_ord")
    aside = shared_dir(spark, "good")
    jsonl.save_jsonl(good, aside)
    jsonl.save_jsonl(jsonl.load_jsonl(spark, aside, _TRIPLE), s.path("triples_canonical.jsonl"))


def traits(spark: SparkSession, s: Settings) -> None:
    p = _passages(spark, s).withColumn("passage_id", passage_id(F.col("book_id"), F.col("chunk_index")))
    people = entity.people(_read(spark, s, "triples_canonical.jsonl", _TRIPLE))
    hits = profile.mentioning(p, people).join(p.select("passage_id", "book_id", "chunk_index"), "passage_id")
    found = model.infer_profiles(profile.contexts(profile.with_texts(profile.evenly_sampled(hits), p)), s.profiler)
    ids = profile.first_ids(hits.withColumn("ord", F.struct("book_id", "chunk_index"))).select(F.col("name").alias("person_name"), "source_passage_ids")
    books = hits.groupBy(F.col("name").alias("person_name")).agg(F.min("book_id").alias("book_id"))
    jsonl.save_jsonl(found.join(ids, "person_name").join(books, "person_name"), s.path("traits_raw.jsonl"))
    raw = _read(spark, s, "traits_raw.jsonl", PROFILE)
    jsonl.save_jsonl(quality.good_profiles(raw, s.confidence), s.path("traits_final.jsonl"))


def _graph(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame]:
    t = _read(spark, s, "triples_canonical.jsonl", _TRIPLE)
    p = _read(spark, s, "traits_final.jsonl", PROFILE).withColumn("ord", F.lit(0)) if Path(s.path("traits_final.jsonl")).exists() else None
    return graph.nodes(t, p), graph.edges(t)


def build_graph(spark: SparkSession, s: Settings) -> None:
    node, edge = _graph(spark, s)
    graphml.save_graphml(node, edge, s.path("graph.graphml"))
    ns, es = graph.exported(node, edge)
    with open(s.path("graph.json"), "w", encoding="utf-8") as f:  # one row at a time
        for k, (name, rows) in enumerate((("nodes", ns), ("edges", es))):
            f.write(("{" if k == 0 else ", ") + json.dumps(name) + ": [")
            for i, r in enumerate(rows.toLocalIterator()):
                f.write((",\n" if i else "\n") + r["json"])
            f.write("\n]")
        f.write("}\n")


def draw(spark: SparkSession, s: Settings) -> None:
    viz.save_html(*_graph(spark, s), s.path("graph.html"))


def evaluate(spark: SparkSession, s: Settings) -> dict:
    """The metrics of what the folder holds, by section; a section's values are bounded in number."""
    there = lambda name: Path(s.path(name)).exists()
    t = _read(spark, s, "triples_canonical.jsonl", _TRIPLE) if there("triples_canonical.jsonl") else None
    p = _read(spark, s, "traits_final.jsonl", PROFILE) if there("traits_final.jsonl") else None
    node, edge = _graph(spark, s) if there("graph.graphml") else (None, None)
    out: dict = {"pipeline_config": {"model_name": s.model_name, "confidence_threshold": s.confidence}}
    rows = metrics.evaluated(t, p, edge, node)
    for r in rows.collect() if rows is not None else []:
        out.setdefault(r["section"], {})[r["metric"]] = r["value"]
    jsonl.save_json(out, s.path("metrics.json"))
    return out


_DO = {"extract": extract, "canonicalize": canonicalize, "qa_filters": qa_filters, "traits": traits, "build_graph": build_graph, "viz": draw, "evaluate": evaluate}


def run(spark: SparkSession, s: Settings, stages: tuple[str, ...] = STAGES) -> dict:
    """The stages in order, logged, and the summary that is written at the end; a stage that fails ends the run."""
    log, began, done = RunLog(s.path("trace.jsonl")), time.time(), []
    for name in stages:
        with log.stage(name):
            _DO[name](spark, s)
        done.append(name)
    summary = {"stages_completed": done, "total_duration_seconds": round(time.time() - began, 3), "artifacts": {n: s.path(ARTIFACTS[n]) for n in done}}
    log.summary(s.path("run_summary.json"), **summary)
    return summary
