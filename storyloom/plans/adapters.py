"""The library's records made from the standard tables, as DataFrames and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.operators.tables import ranked
from storyloom.schemas import RELATIONS, TRAITS

EVENT_TRAITS = {"click": "openness", "view": "conscientiousness", "signup": "extraversion", "purchase": "agreeableness", "error": "neuroticism"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a line item; ``ord`` is made of its keys, so that no rank over all rows is needed."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.floor(F.sqrt((F.col("l_partkey") % 361).cast("double"))) + 1).cast("int"))
    start = (F.col("l_linenumber") * 10).cast("long")
    return x.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 65536 + F.col("l_partkey")) * 2048 + F.col("l_suppkey")).alias("ord"),
        F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("subject"),
        relation.alias("relation"),
        F.concat(F.lit("E"), F.col("l_partkey").cast("string")).alias("object"),
        ((100 - 5 * F.round(F.col("l_discount") * 100).cast("int")).cast("double") / F.lit(100.0)).alias("confidence"),
        F.struct(F.col("p_name").alias("text"), start.alias("start"), (start + F.floor("l_quantity").cast("long") - 5).alias("end")).alias("evidence_span"),
        F.col("o_orderpriority").alias("book_id"),
        F.col("l_orderkey").alias("source"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of odd keys stand for the one before; one more row makes a chain."""
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").filter(k % 2 == 1).select(F.concat(F.lit("E"), k.cast("string")).alias("alias"), F.concat(F.lit("E"), (k - 1).cast("string")).alias("canonical"), ((k % 10).cast("double") / 10.0).alias("confidence"))
    return m.union(spark.range(1).select(F.lit("E6"), F.lit("E4"), F.lit(0.9)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a user: a trait for each kind of event, with the first three events as evidence."""
    e = table(spark, sf_dir, "events")
    trait = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_TRAITS.items() for x in kv)), F.col("event_type"))
    w = W.partitionBy("person_name", "trait_name").orderBy("event_id")
    x = e.select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("person_name"), trait.alias("trait_name"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    x = x.withColumn("n", F.row_number().over(w))
    span = F.struct(F.expr("repeat('x', cast(k as int))").alias("text"), F.floor(F.col("value") * 10).cast("long").alias("start"), (F.floor(F.col("value") * 10) + F.col("k")).cast("long").alias("end"))
    t = x.groupBy("person_name", "trait_name").agg(
        F.avg(F.least(F.col("value") / 500, F.lit(1.0))).alias("score"),
        F.max(F.when(F.col("n") <= 3, (F.col("event_id") % 100).cast("double") / 100.0)).alias("confidence"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", span.alias("s"))))), lambda s: s["s"]).alias("evidence_spans"),
    )
    place = F.array_position(F.array(*map(F.lit, TRAITS)), F.col("trait_name"))
    out = t.groupBy("person_name").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("i"), F.struct("trait_name", "score", "confidence", "evidence_spans").alias("t")))), lambda s: s["t"]).alias("traits"))
    return out.withColumn("source_passage_ids", F.array(F.concat(F.col("person_name"), F.lit("_0")))).withColumn("ord", F.substring("person_name", 2, 20).cast("long"))


def passages(spark: SparkSession, sf_dir: str, text: Column | None = None, name: str = "text") -> DataFrame:
    """One a document: its source is the book. Ids are ranked, texts, or what is made of them, join them."""
    d = table(spark, sf_dir, "documents")
    place = ranked(d.select("doc_id", "source"), "source", ["doc_id"], "chunk_index").select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"))
    d = d.select("doc_id", F.col("source").alias("book_id"), (F.col("text") if text is None else text).alias(name))
    return d.join(place, "doc_id").select("doc_id", "book_id", "chunk_index", name).withColumn("passage_id", F.concat_ws("_", "book_id", F.col("chunk_index").cast("string")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.lower(F.substring_index("text", " ", 1)).alias("name")).distinct()


def chaptered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings: a document's first half, line 2 and on below two to four of them."""
    d = table(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.concat(F.lit("Preface\nCHAPTER I\n"), F.substring("text", F.lit(1), half), F.lit("\nBook 2 of more\n"), F.substring("text", half + 1, F.length("text")))
    more = F.when(F.col("doc_id") % 2 == 0, F.lit("\n3. End\nlast\n  part iv  \n")).otherwise(F.lit(""))
    return d.select("doc_id", F.concat(head, more).alias("text"))


_LIST = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_TRAITS.items()) + " end"
_PLACE = "case trait_name " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(TRAITS)) + " end"

#: Common table expressions; ``sql`` puts those that a query needs before it.
CTE = {
    "triples": f"""select ((l_orderkey * 8 + l_linenumber) * 65536 + l_partkey) * 2048 + l_suppkey as ord, 'E' || o_custkey as subject,
  ({_LIST})[1 + floor(sqrt(l_partkey % 361))::int] as relation, 'E' || l_partkey as object,
  (100 - 5 * round(l_discount * 100)::int)::double / 100::double as confidence, p_name as ev_text, l_linenumber::bigint * 10 as ev_start,
  l_linenumber::bigint * 10 + floor(l_quantity)::bigint - 5 as ev_end, o_orderpriority as book_id, l_orderkey as source
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "sure": "select * from triples where coalesce(confidence, 0) >= 0.65",
    "seen": "select * from sure where ev_start < ev_end and length(ev_text) between 10 and 500 and trim(ev_text) <> ''",
    "qa": "select *, min(ord) over (partition by subject, relation, object) as first_ord from seen where subject <> object and subject <> '' and object <> '' qualify row_number() over (partition by subject, relation, object order by confidence desc, ord) = 1",
    "aliases": "select 'E' || c_custkey as alias, 'E' || (c_custkey - 1) as canonical, (c_custkey % 10) / 10::double as confidence from customer where c_custkey % 2 = 1 union all select 'E6', 'E4', 0.9::double",
    "ev": f"select event_id, 'U' || user_id as person_name, {_CASE} as trait_name, value, (props->>'$.k')::bigint as k, row_number() over (partition by user_id, event_type order by event_id) as n from events",
    "spans": "select person_name, trait_name, n, floor(value * 10)::bigint as s, floor(value * 10)::bigint + k as e, k, event_id from ev where n <= 3",
    "traits": "select person_name, trait_name, avg(least(value / 500, 1.0::double)) as score, max(case when n <= 3 then (event_id % 100) / 100::double end) as confidence, count(*) filter (n <= 3) as n_spans from ev group by 1, 2",
    "clash": "select distinct a.person_name, a.trait_name from spans a join spans b on a.person_name = b.person_name and a.trait_name = b.trait_name and a.n < b.n where a.k >= 50 and b.k >= 50 and greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) > 0 and greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s)::double > 0.3",
    "good": "select t.* from traits t join (select person_name, trait_name from spans group by 1, 2 having count(*) >= 2 and count(*) filter (k >= 50) >= 2) g using (person_name, trait_name) left join clash c on c.person_name = t.person_name and c.trait_name = t.trait_name where c.person_name is null and t.confidence >= 0.65",
    "finals": "select * from good where person_name in (select person_name from good group by 1 having count(*) >= 3)",
    "passages": "select doc_id, source as book_id, (row_number() over (partition by source order by doc_id) - 1)::int as chunk_index, text, source || '_' || (row_number() over (partition by source order by doc_id) - 1) as passage_id from documents",
    "names": "select distinct lower(string_split(text, ' ')[1]) as name from benchmark",
    "hits": "select p.*, n.name from passages p join names n on contains(lower(p.text), n.name)",
    "sampled": "select *, row_number() over (partition by name order by chunk_index, passage_id) - 1 as i, count(*) over (partition by name) as n from hits",
    "even": "select * from sampled where n <= 50 or (i % (n // 50) = 0 and i < (n // 50) * 50)",
    "used": "select *, sum(length(passage_id) + 18 + length(text)) over (partition by name order by i) as used from even",
    "edges": "select subject as src, object as dst, row_number() over (partition by subject, object order by ord) - 1 as key, relation, coalesce(confidence, 0) as confidence, coalesce(ev_text, '') as evidence, ord from {base}",
    "deg": "select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id",
    "pairs": "select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst",
    "ways": "select a, b from pairs union all select b, a from pairs",
    "reach": "select id, id from deg union select ways.b, min(reach.component) from reach join ways on ways.a = reach.id join recurring.reach old on old.id = ways.b where reach.component < old.component group by ways.b",
    "comp": "select id, component from reach",
    "chaptered": "select doc_id, 'Preface' || chr(10) || 'CHAPTER I' || chr(10) || substring(text, 1, (length(text) // 2)::int) || chr(10) || 'Book 2 of more' || chr(10) || substring(text, (length(text) // 2)::int + 1) || case when doc_id % 2 = 0 then chr(10) || '3. End' || chr(10) || 'last' || chr(10) || '  part iv  ' || chr(10) else '' end as text from documents",
}
#: Recursions that keep one row a key, the last.
_KEYED = {"reach": "reach(id, component) using key (id)"}
_NEEDS = {
    "sure": ["triples"], "seen": ["sure"], "qa": ["seen"], "spans": ["ev"], "traits": ["ev"], "clash": ["spans"], "good": ["traits", "spans", "clash"],
    "finals": ["good"], "hits": ["passages", "names"], "sampled": ["hits"], "even": ["sampled"], "used": ["even"], "deg": ["edges"], "pairs": ["edges"], "ways": ["pairs"], "reach": ["deg", "ways"], "comp": ["reach"],
}


def sql(query: str, *needs: str, base: str = "qa") -> str:
    """The query after the expressions it needs, and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in [base] if name == "edges" else _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    recursive = "recursive " if "reach" in order else ""
    return f"with {recursive}" + ",\n".join(f"{_KEYED.get(n, n)} as ({CTE[n].format(base=base) if n == 'edges' else CTE[n]})" for n in order) + "\n" + query if order else query
