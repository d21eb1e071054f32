"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from storyloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: float(x) if isinstance(x, float) else x
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.oracle_sql()[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_known_sums_of_the_quality_pass(spark):
    d = "/root/testdata/sf0.01"
    r = registry.queries()["agg12_pass_counts"](spark, d).first()
    assert (r.initial, r.confident, r.with_evidence, r.final) == (60000, 45064, 16559, 16424)
    m = registry.queries()["agg5_6_relation_diversity"](spark, d).first()
    assert (m.entropy, m.gini, m.n_relations) == (3.983104, 0.316796, 19)
