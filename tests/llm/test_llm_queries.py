"""The registered queries and the pipeline on the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from storyloom.llm import line_dedup, quality_rules, queries, secrets
from storyloom.llm.common import documents, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(c[0] for c in cur.description)
    place = [c[0] for c in cur.description]
    want = sorted(repr([v[place.index(c)] for c in cols]) for v in cur.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_has_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() >= 200 and "doc_id" in df.columns


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    d = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = written(stage(spark, d, SF), "t")
        assert d.columns == before.columns, name
        texts, old = ({r.doc_id: r.text for r in x.collect()} for x in (d, before))
        if name == "quality rules":
            assert texts.keys() == {r.doc_id for r in quality_rules.query(spark, SF).filter("kept").collect()}
        elif name == "line dedup":
            assert texts == {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect()}
        elif name == "near duplicates":
            sets = {k: shingles(v) for k, v in old.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            assert not [(a, b) for a in texts for b in texts if a < b and alike(a, b) >= 0.85]
            assert all(any(b < a and alike(a, b) >= 0.7 for b in sets) for a in old.keys() - texts.keys())
        else:
            assert not [r for r in secrets.scan(d).collect() if r.spans]
    out = written(corpus_pipeline.STAGES[-1][1](spark, d, SF), "t")
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in d.collect()}


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "secret scan", "packing"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != "near duplicates"])
    kept = quality_rules.query(spark, SF).filter("kept")
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in kept.collect()}
