"""Hand-made cases and invariants."""

import itertools
import json
import random
from urllib.parse import unquote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import chunk, entity, graph, ingest, metrics, model, paths, profile, quality, synth, tables, viz
from storyloom import ingest as ingest_run
from storyloom import run
from storyloom.operators.tables import ranked
from storyloom.plans import registry
from storyloom.schemas import PASSAGE, PROFILE, TRIPLE, profile_violations, triple_violations, validate
from storyloom.sources import graphml, jsonl, pdf
from storyloom.streaming import passages as stream

T7 = "ord long, subject string, relation string, object string, confidence double, evidence_span struct<text:string,start:long,end:long>, book_id string"


def triples(spark, *rows):
    return spark.createDataFrame([(i, s, r, o, c, (t, 0, 9) if t is not None else None, "b") for i, (s, r, o, c, t) in enumerate(rows)], T7)


EV = "evidence text of enough length"


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (T.dehyphenate, "won-\n der-\n\nful", "wonderful"),
        (T.collapse_spaces, "a   b\t\tc", "a b\t\tc"),
        (T.drop_running_lines, "H\nx\nH\ny\nH\nz\nH\nw\nH", "x\ny\nz\nw"),
        (T.drop_running_lines, "H\nx\nH\ny\nH\nz\nH", "H\nx\nH\ny\nH\nz\nH"),
        (T.drop_running_lines, "a\nPage 12 was missing\n 12 – 13 \np. 4\nb", "a\nb"),
        (T.drop_running_lines, "\n".join(["r" * 80] * 5), "\n".join(["r" * 80] * 5)),
        (T.paragraphs, "a\nb\n\n\n\nc\n\n  \n\nd", "a b\n\nc\n\nd"),
        (T.strip, "  a \n", "a"),
        (T.slug, "The  Été — Vol. 2!", "the-ete-vol-2"),
    ],
)
def test_cleaning(spark, step, text, want):
    assert one(spark, step(F.col("t")), t=text) == want


def test_nfc_and_whole_cleaning(spark):
    df = spark.createDataFrame([("café is   here-\nabouts\nnow\n\n\nend",), (None,), ("",)], "text string")
    assert [r.cleaned for r in T.clean(df).collect()] == ["café is hereabouts now\n\nend", None, ""]


def test_titles(spark):
    t = lambda s: tuple(one(spark, T.title_and_author(F.col("s")), s=s))
    assert t("Ann Lee - Dust") == ("Dust", "Ann Lee")
    assert t("A Very Long Title - Ann Lee") == ("A Very Long Title", "Ann Lee")
    assert t("Dust By Ann") == ("dust", "ann")
    assert t("Dust") == ("Dust", "Unknown")


def test_templates_keep_doubled_braces(spark):
    assert one(spark, T.filled(F.lit('{{"a": {x}}}'), {"x": F.col("v")}), v="100% {x}") == '{"a": 100% {x}}'


def test_chapters(spark):
    df = spark.createDataFrame([(1, "pre\nCHAPTER I\na\npart in the play\nb\n  Book 2\nc"), (2, "no heading"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chapter, r.text) for r in chunk.by_chapters(df).orderBy("doc_id", "chapter").collect()]
    assert got == [(1, 1, "CHAPTER I\na"), (1, 2, "part in the play\nb"), (1, 3, "Book 2\nc")]
    assert {(r.doc_id, r.method) for r in chunk.split_text(df).collect()} == {(1, "chapter"), (2, "length")}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=600), st.integers(5, 30), st.integers(0, 40))
def test_chunks_cover_the_text(text, least, more):
    overlap, most = least - 1, least + more + 1
    got = list(chunk.cuts(text, least, most, overlap))
    assert [s for s, _ in got] == sorted({s for s, _ in got})
    assert all(e - s <= most for s, e in got) and all(b[0] == a[1] - overlap for a, b in zip(got, got[1:], strict=False))
    assert (got[0][0], got[-1][1]) == (0, len(text)) if text else got == []


def test_chunk_sizes_that_cannot_advance(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk.by_length(spark.createDataFrame([(1, "a")], "doc_id long, text string"), least=100, overlap=100)


def test_break_just_at_the_least_length_is_not_used():
    assert list(chunk.cuts("a" * 10 + "\n\n" + "b" * 30, 10, 20, 2))[0] == (0, 20)


def test_quality_pass_and_its_counts(spark):
    t = triples(spark, ("A", "K", "B", 0.9, EV), (" A ", "K", "B", 0.9, EV), ("a", "K", "B", 0.7, EV), ("A", "K", "B", 0.95, EV), ("A", "K", "A ", 0.9, EV), ("A", "K", "C", 0.5, EV), ("A", "K", "D", None, EV), ("A", "K", "E", 0.9, None), ("A", "K", "F", 0.9, "short"), ("", "K", "G", 0.9, EV))
    seen = Observation()
    got = {(r.subject, r.object): (r.ord, r.confidence, r.first_ord) for r in quality.quality_pass(t, observation=seen).collect()}
    assert got == {("A", "B"): (3, 0.95, 0), ("a", "B"): (2, 0.7, 2)}
    assert seen.get == {"initial": 10, "confident": 8, "with_evidence": 6}
    assert quality.retention(10, 2) == "20.0%" and quality.retention(0, 0) == "0.0%"
    again = quality.deduplicated(quality.deduplicated(t).drop("first_ord"))
    assert again.count() == quality.deduplicated(t).count()


def test_ties_keep_the_first(spark):
    t = triples(spark, ("A", "K", "B", 0.9, "first evidence text"), ("A", "K", "B", 0.9, "other evidence text"))
    assert quality.quality_pass(t).first().evidence_span.text == "first evidence text"


def span(a, b):
    return ("x" * 60, a, b)


@pytest.mark.parametrize(("spans", "good"), [([span(0, 100), span(70, 170)], True), ([span(0, 100), span(69, 169)], False), ([span(0, 100), span(200, 300), span(10, 90)], False), ([span(0, 100), ("short", 0, 100)], False), ([span(5, 5), span(0, 100)], True), ([], False)])
def test_trait_evidence(spark, spans, good):
    p = spark.createDataFrame([("p", [("openness", 0.5, 0.9, spans)] * 3, [], "b")], PROFILE)
    assert p.select(F.transform("traits", lambda t: quality.good_trait(t))[0]).first()[0] is good
    assert quality.good_profiles(p).count() == int(good)


def test_canonical_names_are_looked_up_once(spark):
    t = triples(spark, ("A", "K", "B", 0.9, EV), ("X", "K", "A", 0.9, EV))
    m = spark.createDataFrame([("A", "B", 0.9, 0), ("B", "C", 0.9, 1), ("X", "Y", 0.9, 2), ("X", "Z", 0.9, 3), ("K", "Q", 0.1, 4)], "alias string, canonical string, confidence double, ord long")
    assert [(r.subject, r.object) for r in entity.canonicalised(t, m).orderBy("ord").collect()] == [("B", "C"), ("Z", "B")]


def test_case_mapping(spark):
    t = triples(spark, ("Ann", "K", "ann", 0.9, EV), ("Ann", "K", "Bob", 0.9, EV))
    assert {tuple(r) for r in entity.case_mapping(t).collect()} == {("Ann", "Ann"), ("ann", "Ann")}


def test_context_budget(spark):
    def fits(n_chars):
        size = len("\n--- Passage p_0 ---\n")
        h = spark.createDataFrame([("n", "p_0", 0, "x" * (n_chars - size))], "name string, passage_id string, chunk_index int, text string")
        return profile.within_budget(profile.evenly_sampled(h)).count()

    assert (fits(12000), fits(12001)) == (1, 0)


@pytest.mark.parametrize(("n", "want"), [(50, 50), (51, 50), (99, 50), (100, 50), (101, 50), (7, 7), (149, 50)])
def test_even_sampling(spark, n, want):
    h = spark.range(n).selectExpr("'n' as name", "concat('p_', id) as passage_id", "cast(id as int) as chunk_index", "'t' as text")
    got = sorted(r.chunk_index for r in profile.evenly_sampled(h).collect())
    assert len(got) == want and got == [i * max(1, n // 50) for i in range(want)]


def test_mentions_by_automaton_and_by_join(spark):
    p = spark.createDataFrame([("a", "Anna met BOB"), ("b", None), ("c", "bo")], "passage_id string, text string")
    n = spark.createDataFrame([("ann",), ("Bob",), ("bob",), ("",)], "name string")
    want = {("a", "ann"), ("a", "Bob"), ("a", "bob")}
    assert {tuple(r) for r in profile.mentioning(p, n).collect()} == want
    assert {tuple(r) for r in profile.mentioning_by_join(p, n.filter("name <> ''")).collect()} == want


def path_graph(spark):
    t = triples(spark, ("a", "K", "b", 0.9, EV), ("b", "K", "c", 0.8, EV), ("b", "K", "c", 0.7, EV), ("c", "K", "c", 0.9, EV), ("c", "LOVES", "d", None, None), ("x", "HATES", "y", 0.9, EV))
    return graph.nodes(t), graph.edges(t)


def test_graph_measures(spark):
    n, e = path_graph(spark)
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    t = graph.totals(e).first()
    assert (t.n_nodes, t.n_edges, t.max_degree) == (6, 6, 5) and t.density == pytest.approx(6 / 30)
    assert sum(r.degree for r in graph.degrees(e).collect()) == 12
    assert sorted(r.key for r in e.filter("src = 'b'").collect()) == [0, 1]
    p = graph.path_measures(e).first()
    assert (p.avg_path_length, p.diameter) == (pytest.approx(10 / 6), 3)
    assert [r.id for r in graph.top_nodes(e, n, 2).collect()] == ["c", "b"]
    assert {(r.src, r.dst) for r in graph.ego(e, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", "b")}


def test_clustering_of_a_triangle_with_a_tail(spark):
    t = triples(spark, ("a", "K", "b", 0.9, EV), ("b", "K", "c", 0.9, EV), ("c", "K", "a", 0.9, EV), ("c", "K", "d", 0.9, EV))
    assert {r.id: round(r.clustering, 3) for r in graph.clustering(graph.edges(t)).collect()} == {"a": 1.0, "b": 1.0, "c": 0.333, "d": 0.0}


def test_empty_inputs(spark):
    t = triples(spark).limit(0)
    assert quality.quality_pass(t).count() == 0
    assert graph.components(graph.edges(t)).count() == 0
    assert metrics.confidence_distribution(t).first().bin_0 == 0
    assert metrics.relation_diversity(t).first().entropy == 0
    assert metrics.evaluated(None, None, None) is None
    assert metrics.scored(t, t).first().f1 == 0


def test_confidence_bins_are_half_open(spark):
    t = triples(spark, *(("a", "K", "b", c, EV) for c in (0.5, 0.7, 0.85, 0.95, 0.0)))
    r = metrics.confidence_distribution(t).first()
    assert [r[f"bin_{i}"] for i in range(5)] == [1, 1, 1, 1, 1]
    one_relation = metrics.relation_diversity(t).first()
    assert (one_relation.entropy, one_relation.normalized_entropy) == (0, 0)


def test_constraints(spark):
    rows = [("a", "K", "b", 0.5, ("t", 0, 1), "p", "b"), ("a", "K", "b", 1.5, ("t", 3, 1), "p", "b"), ("a", "K", "b", None, None, None, None)]
    got = validate(spark.createDataFrame(rows, TRIPLE), triple_violations()).collect()
    assert [r.violations for r in got] == [[], ["confidence", "span_order"], ["confidence"]]
    five = [(t, 0.5, 0.5, []) for t in ("Openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")]
    p = spark.createDataFrame([("x", five, [], None), ("y", five[:3], [], None), ("z", [("luck", 0.5, 0.5, [])], [], None)], PROFILE)
    assert [r.violations for r in validate(p, profile_violations()).collect()] == [[], ["five_traits"], ["trait_name", "five_traits"]]


def test_worlds_and_stories(spark):
    w = synth.world(3)
    assert synth.world(3) == w != synth.world(4) and len(w.people) == 7 and len(w.facts) >= 20
    assert {r for _, r, _ in w.facts} <= set(synth.RELATIONS) and all(s in w.people for s, _, _ in w.facts)
    assert all(set(scores) == set(synth.TRAITS) and 0 < min(scores.values()) for scores in w.people.values())
    got = {r.passage_id: r for r in synth.passages(spark, 40, seed=3).collect()}
    for i in range(40):  # each row is what its number alone gives
        want = synth.passage(3, i, 800, 1500)
        r = got[want["passage_id"]]
        assert (r.text, r.featured, [t.asDict() for t in r.triples]) == (want["text"], want["featured"], want["triples"])
        assert 800 <= len(r.text) <= 1503 and set(r.featured) <= set(w.people)
        for t in r.triples:
            assert (t.subject, t.relation, t.object) in w.facts and t.subject in r.featured
            assert r.text.endswith("...") or any(x.format(subj=t.subject, obj=t.object, relation=t.relation.lower().replace("_", " ")) in r.text for x in synth.SAID.get(t.relation, synth.SAID[None]))


def test_models_end_to_end(spark):
    p = synth.passages(spark, 60, most=100_000)
    assert p.collect() == synth.passages(spark, 60, most=100_000).repartition(7).orderBy("chunk_index").collect()
    score = metrics.scored(model.extract(p), synth.facts(p)).first()
    assert (score.precision, score.recall) == (1.0, 1.0)
    people = spark.createDataFrame([(c,) for c in synth.world().people], "name string")
    ctx = profile.contexts(profile.evenly_sampled(profile.mentioning(p, people).join(p, "passage_id")))
    found = model.infer_profiles(ctx).select("person_name", F.inline("traits")).select("person_name", "trait_name", "score", F.size("evidence_spans").alias("n"))
    assert metrics.trait_error(found.drop("n"), synth.truth(spark)[1]).first().mae < 0.35
    texts = {r.name: r.context for r in ctx.collect()}
    for r in found.collect():
        much, little = (sum(texts[r.person_name].count(x.format(char=r.person_name)) for x in side) for side in synth.SHOWN[r.trait_name])
        assert r.n == much + little and r.score == pytest.approx((0.8 * much + 0.2 * little) / r.n)


def test_a_run_from_passages_to_metrics(spark, tmp_path):
    synth.passages(spark, 40, most=100_000).select("book_id", "title", "chunk_index", "text").repartition(2).write.json(str(tmp_path / "in"))
    s = run.Settings(str(tmp_path / "in"), str(tmp_path / "out"))
    said = run.run(spark, s)
    assert said["stages_completed"] == list(run.STAGES) and all((tmp_path / "out" / name).exists() for name in (*run.ARTIFACTS.values(), "graph.json", "traits_raw.jsonl", "run_summary.json"))
    facts = {(r.subject, r.relation, r.object) for r in synth.facts(synth.passages(spark, 40, most=100_000)).collect()}
    held = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert held["triples"]["n_triples"] == len(facts) and held["graph"]["n_edges"] == len(facts)
    assert {"graph_quality", "personality", "personality_stats", "top_relations", "most_connected", "evidence", "relations"} <= held.keys()
    drawn = json.loads((tmp_path / "out" / "graph.json").read_text())
    assert len(drawn["edges"]) == len(facts) and len(drawn["nodes"]) == held["graph"]["n_nodes"]
    assert [e["stage"] for e in map(json.loads, (tmp_path / "out" / "trace.jsonl").read_text().splitlines())] == [n for n in run.STAGES for _ in range(2)]
    few = run.Settings(str(tmp_path / "in"), str(tmp_path / "few"), max_passages=3)
    assert run.run(spark, few, ("extract",))["stages_completed"] == ["extract"]
    assert "SCHEMA RELATIONS" in s.prompt("triples") and "{passage_text}" in s.prompt("triples")


def test_command_line(spark, tmp_path, capsys):
    from storyloom.__main__ import main, parser

    synth.passages(spark, 6, most=100_000).select("book_id", "title", "chunk_index", "text").coalesce(1).write.json(str(tmp_path / "in"))
    assert main(["extract", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out)["stages_completed"] == ["extract"]
    assert main(["graph", "--output", str(tmp_path / "none")]) == 1
    assert parser().parse_args(["ingest", "--pdf-root", "x"]).max_chars == 2000


def test_ingest_skips_what_is_done(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "bad"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(name.encode())

    def text(content):
        return {b"a": ["Page one. " * 300, "two"], b"b": ["Other words. " * 20], b"c": ["changed " * 30]}[content]

    go = lambda: ingest_run.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), "text", readers={"text": text})
    first = go()
    assert (first["successful"], first["skipped"], first["failed"]) == (2, 0, 1)
    again = go()
    assert (again["successful"], again["skipped"], again["failed"]) == (0, 2, 1)
    (tmp_path / "in" / "b.pdf").write_bytes(b"c")
    third = go()
    assert (third["successful"], third["skipped"]) == (1, 1)
    rows = spark.read.json(str(tmp_path / "out" / "jsonl"))
    assert {r.book_id for r in rows.select("book_id").distinct().collect()} == {"a", "b"}
    assert "changed" in rows.filter("book_id = 'b'").first().text
    assert spark.read.json(str(tmp_path / "out" / "metadata" / "manifests")).count() == 2


def test_ranks_of_a_group_that_holds_most_rows(spark):
    rows = [("hot" if i % 5 else f"k{i % 3}", (i * 7919) % 1000, i) for i in range(600)] + [(None, 1, 1), (None, 0, 2)]
    df = spark.createDataFrame(rows, "k string, o long, i long").repartition(5)
    got = ranked(df, "k", ["o", "i"], "rank", "total").collect()
    by = {}
    for k, o, i in rows:
        by.setdefault(k, []).append((o, i))
    assert sorted((r.k or "", r["rank"], r.o, r.i, r.total) for r in got) == sorted((k or "", n, *x, len(v)) for k, v in by.items() for n, x in enumerate(sorted(v)))


def test_names_by_words_where_there_are_too_many(spark, monkeypatch):
    p = spark.createDataFrame([("a", "Anna met BOB Longfellow"), ("b", None), ("c", "bo"), ("d", "x")], "passage_id string, text string")
    n = spark.createDataFrame([("ann",), ("Bob",), ("bob longfellow",), ("",), ("X",), ("longfellows",)], "name string")
    want = {tuple(r) for r in profile.mentioning(p, n).collect()}
    monkeypatch.setattr(profile, "NAMES_AT_ONCE", 2)
    assert {tuple(r) for r in profile.mentioning(p, n).collect()} == want == {("a", "ann"), ("a", "Bob"), ("a", "bob longfellow"), ("d", "X")}


def test_paths_by_walks_and_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(150)}", "K", f"n{rng.randrange(150)}", 0.9, EV) for _ in range(170)]
    e = graph.edges(triples(spark, *rows))
    near = {}
    for a, _, b, *_ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen = {}
    for s in near:
        far, step = {s: 0}, [s]
        while step:
            step = [y for x in step for y in near[x] if y not in far and not far.__setitem__(y, far[x] + 1)]
        seen[s] = far
    most = max(map(len, seen.values()))
    first = min((s for s in seen if len(seen[s]) == most), key=lambda s: min(seen[s]))
    dist = [d for s in seen[first] for d in seen[s].values() if d]
    want = (pytest.approx(sum(dist) / len(dist)), max(dist))
    assert tuple(graph.path_measures(e).first()) == want
    monkeypatch.setattr(graph, "TASK_BITS", 64 * most)  # many blocks of sources
    assert tuple(graph.path_measures(e).first()) == want
    monkeypatch.setattr(graph, "MOST_LINKS", 1)
    assert tuple(graph.path_measures(e).first()) == want


def test_a_failing_model_gives_no_rows(spark):
    class Broken:
        def __call__(self, **_):
            raise RuntimeError("down")

    p = synth.passages(spark, 3)
    assert model.extract(p, Broken).count() == 0
    assert model.extract(p, lambda: lambda **_: "no json").count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "t", ["x"], "p", "text", None, 0, 0, 3, "é\nz")], PASSAGE)
    jsonl.save_jsonl(df, str(tmp_path / "p.jsonl"))
    assert jsonl.load_jsonl(spark, str(tmp_path / "p.jsonl"), PASSAGE).collect() == df.collect()
    assert list(jsonl.iter_jsonl(spark, str(tmp_path / "p.jsonl"), PASSAGE))[0]["text"] == "é\nz"
    (tmp_path / "bad.jsonl").write_text('{"book_id": "a"}\n\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.load_jsonl(spark, str(tmp_path / "bad.jsonl"), PASSAGE).collect()
    assert [p.rpartition("/")[2] for p in jsonl.discover(spark, str(tmp_path))] == ["bad.jsonl"]
    jsonl.save_json({"a": [1, None, "é"]}, str(tmp_path / "x" / "a.json"))
    assert jsonl.load_json(spark, str(tmp_path / "x" / "a.json")).first().a == ["1", None, "é"]
    with pytest.raises(FileNotFoundError):
        jsonl.load_prompt(str(tmp_path), "none")


def test_graphml_round_trip(spark, tmp_path):
    n, e = path_graph(spark)
    graphml.save_graphml(n, e, str(tmp_path / "g.graphml"))
    n2, e2 = graphml.load_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.id, r.label) for r in n2.collect()} == {(r.id, r.label) for r in n.collect()}
    key = lambda df: sorted((r.src, r.dst, r.key, r.relation, r.confidence) for r in df.collect())
    assert key(e2) == key(e)
    viz.save_html(n, e, str(tmp_path / "g.html"))
    assert "<svg" in (tmp_path / "g.html").read_text()


def test_pdf_chain_and_types(spark, tmp_path):
    for name, body in (("Ann Lee - Dust.pdf", b"good"), ("scan.pdf", b"scan"), ("bad.pdf", b"bad")):
        (tmp_path / name).write_bytes(body)

    def text(content):
        return {b"good": ["Page one. " * 30, "two"], b"scan": [" "]}[content]

    def ocr(content):
        return {b"scan": ["read by eye"]}[content]

    files = pdf.discover_pdfs(spark, str(tmp_path))
    pages = pdf.pages(files, {"text": text, "ocr_x": ocr})
    assert sorted((unquote(r.path.rpartition("/")[2]), r.extraction_mode, r.page_no) for r in pages.collect()) == [("Ann Lee - Dust.pdf", "text", 0), ("Ann Lee - Dust.pdf", "text", 1), ("scan.pdf", "ocr_x", 0)]
    assert {r.pdf_type for r in pdf.pdf_types(pages).collect()} == {"text", "ocr"}
    books = ingest.books(pdf.book_texts(pages).withColumn("path", F.replace("path", F.lit("%20"), F.lit(" "))))
    parts = ingest.passages(books)
    assert {(r.title, r.authors[0]) for r in books.collect()} == {("Dust", "Ann Lee"), ("scan", "Unknown")}
    m = ingest.manifests(books, parts, files)
    assert {r.num_chunks for r in m.collect()} == {1}


def test_run_log(tmp_path):
    log = ingest.RunLog(str(tmp_path / "t" / "log.jsonl"))
    with log.stage("a"):
        pass
    with pytest.raises(ZeroDivisionError), log.stage("b"):
        1 / 0
    assert [(e["stage"], e["message"]) for e in map(json.loads, log.path.read_text().splitlines())] == [("a", "start"), ("a", "complete"), ("b", "start"), ("b", "failed")]


def test_stream_of_passages(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    p = synth.passages(spark, 20, most=100_000)
    p.select("book_id", "title", "chunk_index", "text").repartition(3).write.json(str(src))
    t = stream.triple_stream(stream.passage_stream(spark, str(src)))
    stream.write_triples(t, str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == model.extract(p).count() > 0


def test_spellings_of_a_name_are_in_one_batch(spark):
    names = [f"{x}{i}" for i in range(40) for x in ("E", "e")] + ["Ann", "aNN", "ANN", "ann"]
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    want = {(n, min(m for m in names if m.lower() == n.lower())) for n in names} - {(n, n) for n in names}
    for size in (1, 2, 3):
        assert {(r.alias, r.canonical) for r in model.canonicalise(df, batch=size).collect()} == want


def test_texts_stay_out_of_the_ranking_of_hits(spark):
    """A passage has a hit for each name in it, but its text is neither sorted nor joined for each of them."""
    p = spark.range(60).selectExpr("concat('p_', id) as passage_id", "cast(id as int) as chunk_index", "repeat('t', cast(id as int) * 20) as text")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    thin = p.select("passage_id", "chunk_index", F.length("text").alias("chars")).crossJoin(names)
    thick = profile.within_budget(profile.evenly_sampled(p.crossJoin(names))).select("name", "passage_id", "rank", "used")
    got = profile.within_budget(profile.evenly_sampled(thin))
    assert {tuple(r) for r in got.select("name", "passage_id", "rank", "used").collect()} == {tuple(r) for r in thick.collect()}
    assert "text" not in got.columns and "text" in profile.with_texts(got, p).columns
    assert "text" not in registry._hits(spark, "/root/testdata/sf0.001").columns


def test_walks_from_many_sources(monkeypatch):
    """Hubs beyond the widest group, several words of sources, a long chain."""
    rng = random.Random(8)
    links = {tuple(sorted((rng.randrange(300), rng.randrange(300)))) for _ in range(420)} | {(0, k) for k in range(1, 280)} | {(k, k + 1) for k in range(299, 340)}
    a, b = np.array([x for x in links if x[0] != x[1]], np.int32).T
    near = {}
    for x, y in zip(a.tolist(), b.tolist()):
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    dist = []
    for s in near:
        far, level = {s: 0}, [s]
        while level:
            level = [y for x in level for y in near[x] if y not in far and not far.__setitem__(y, far[x] + 1)]
        dist += [d for d in far.values() if d]
    monkeypatch.setattr(paths, "ROWS", 16)
    w = paths.Walker(*paths.renumbered(*paths.neighbours(a, b, 341)))
    assert w.alone
    for size in (64, 130, 341):
        got = [w.walk(lo, min(341, lo + size)) for lo in range(0, 341, size)]
        assert (sum(x[0] for x in got), sum(x[1] for x in got), max(x[2] for x in got)) == (sum(dist), len(dist), max(dist))


def test_paths_leave_no_tables(spark, monkeypatch, tmp_path):
    """Neither the links nor the distances of all pairs stay on disk, whichever way is taken."""
    monkeypatch.setattr(tables, "shared_dir", lambda spark, name, n=itertools.count(): f"{tmp_path}/{name}-{next(n)}")
    e = graph.edges(triples(spark, *((f"n{k:03}", "K", f"n{k + 1:03}", 0.9, EV) for k in range(69))))
    want = (pytest.approx(71 / 3), 69)
    assert tuple(graph.path_measures(e).first()) == want and not list(tmp_path.iterdir())
    monkeypatch.setattr(graph, "MOST_LINKS", 1)
    monkeypatch.setattr(graph, "JOINED_ROWS", 1)  # two batches of sources
    assert tuple(graph.path_measures(e).first()) == want and not list(tmp_path.iterdir())


def test_evaluation_finds_components_once(spark, monkeypatch):
    calls, found = [], graph.components
    monkeypatch.setattr(graph, "components", lambda *a: calls.append(1) or found(*a))
    parts = metrics.graph_quality(path_graph(spark)[1])
    assert len(calls) == 1 and tuple(parts[0].first()) == (2, 4) and tuple(parts[3].first()) == (pytest.approx(10 / 6), 3)
