"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import chunk, entity, graph, ingest, metrics, model, profile, quality, synth, viz
from storyloom.operators.tables import shared_dir
from storyloom.plans import adapters as A
from storyloom.plans.adapters import sql
from storyloom.schemas import TRAITS
from storyloom.sources import jsonl, pdf

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents")


def good(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_pass(A.triples(spark, d))


def finals(spark: SparkSession, d: str) -> DataFrame:
    return quality.good_profiles(A.profiles(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(good(spark, d))


def r6(*names: str) -> list:
    """Sums of doubles, rounded as far as their order of addition doesn't show."""
    return [F.round(n, 6).alias(n) for n in names]


_FLAG = "select relation, count(*) as n, round(avg(confidence), 6) as avg_confidence, round(-(count(*) / sum(count(*)) over ()) * log2(count(*) / sum(count(*)) over ()), 6) as bits from qa group by relation"


@query("flagship_relation_metrics", sql(_FLAG, "qa"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Quality-filtered triples by relation: count, confidence, share of the entropy."""
    t = good(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    p = F.col("n") / F.sum("n").over(W.partitionBy())
    return t.select("relation", "n", F.round("avg_confidence", 6).alias("avg_confidence"), F.round(-p * F.log2(p), 6).alias("bits"))


_CHUNKS = """walk as (select doc_id, text, length(text) as n, 0 as start, {cut0} as stop from {src} where length(text) > 0
  union all select doc_id, text, n, stop - 200 as start, {cut} as stop from walk where stop < n)"""


def _cut(start: str, n: str) -> str:
    """Where a chunk ends, as SQL."""
    part = f"substring(text, ({start}) + 1201, 800)"  # what lies between least and most characters
    last = lambda m: f"case when instr(reverse({part}), reverse({m})) > 0 then 800 - instr(reverse({part}), reverse({m})) - length({m}) + 1 else -1 end"
    best = f"greatest({last(chr(39) + '. ' + chr(39))}, {last(chr(39) + '! ' + chr(39))}, {last(chr(39) + '? ' + chr(39))})"
    para = last("chr(10) || chr(10)")
    return f"(case when ({start}) + 2000 >= {n} then {n} when {para} > 0 then ({start}) + 1200 + {para} when {best} > 0 then ({start}) + 1200 + {best} + 1 else ({start}) + 2000 end)::bigint"


def _walk(src: str) -> str:
    return _CHUNKS.format(src=src, cut0=_cut("0", "length(text)"), cut=_cut("stop - 200", "n")).replace("0 as start", "0::bigint as start")


# --- sources and sinks

_ROUND = "select doc_id, text, lang, source, n_chars from documents"


@query("src1_load_jsonl", _ROUND)
def _(spark, d):
    path = shared_dir(spark, "lines")
    jsonl.save_jsonl(docs(spark, d), path)
    return jsonl.load_jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("src3_books_in_folder", "select source as book_id, count(*) as n from documents group by source")
def _(spark, d):
    path = shared_dir(spark, "books")
    jsonl.save_jsonl(A.passages(spark, d).select("book_id", "chunk_index", "text"), path)
    return jsonl.load_books(spark, path, "book_id string, chunk_index int, text string", "*.json").groupBy("book_id").agg(F.count("*").alias("n"))


_TYPES = "with pages as (select doc_id::varchar as path, unnest(range(0, len(string_split(text, chr(10))))) as page_no, unnest(string_split(text, chr(10))) as t from documents), types as (select path, case when avg(length(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))) filter (page_no < 5) >= 100 then 'text' else 'ocr' end as pdf_type from pages group by path)"


def _pages(spark, d):
    """Each document as a file, each of its lines as a page."""
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("page_no", "text"))


@query("src11_detect_pdf_type", f"{_TYPES} select path, pdf_type from types")
def _(spark, d):
    return pdf.pdf_types(_pages(spark, d))


@query("flt10_only_mode", f"{_TYPES} select path, pdf_type from types where pdf_type = 'text'")
def _(spark, d):
    return pdf.pdf_types(_pages(spark, d)).filter("pdf_type = 'text'")


@query("snk4_graph_json", sql("select 'edge' as kind, src, dst, relation, confidence from edges", "edges"))
def _(spark, d):
    t = good(spark, d)
    _, es = graph.exported(graph.nodes(t), graph.edges(t))
    e = F.from_json("json", "struct<source:string,target:string,attributes:struct<relation:string,confidence:double>>")
    return es.select(F.lit("edge").alias("kind"), e["source"].alias("src"), e["target"].alias("dst"), e["attributes"]["relation"].alias("relation"), e["attributes"]["confidence"].alias("confidence"))


_BOOKS = "select doc_id::varchar as book_id, upper(source) as title, [lang] as authors, source as source_path, 'text' as extraction_mode, text from documents"


def _books(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), F.upper("source").alias("title"), F.array("lang").alias("authors"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), F.lit("text").alias("extraction_mode"), "text")


@query("snk5_denormalised_passages", f"with recursive {_walk('documents')} select walk.doc_id::varchar as book_id, upper(source) as title, lang as author, source || '/' || walk.doc_id as source_path, (row_number() over (partition by walk.doc_id order by start) - 1)::int as chunk_index, start::int as start_char, stop::int as end_char, sha256(regexp_replace(substring(walk.text, (start + 1)::int, (stop - start)::int), '^\\s+|\\s+$', '', 'g')) as h from walk join documents using (doc_id) where regexp_replace(substring(walk.text, (start + 1)::int, (stop - start)::int), '^\\s+|\\s+$', '', 'g') <> ''")
def _(spark, d):
    return ingest.passages(_books(spark, d)).select("book_id", "title", F.col("authors")[0].alias("author"), "source_path", "chunk_index", "start_char", "end_char", F.sha2("text", 256).alias("h"))


@query("snk6_manifest", f"with recursive {_walk('documents')}, n as (select doc_id, count(*) as num_chunks from walk where regexp_replace(substring(text, (start + 1)::int, (stop - start)::int), '^\\s+|\\s+$', '', 'g') <> '' group by 1) select d.doc_id::varchar as book_id, upper(source) as title, lang as author, 1900 + (d.doc_id % 100)::int as year, source || '/' || d.doc_id as source_path, 'text' as extraction_mode, 'length' as split_method, coalesce(num_chunks, 0) as num_chunks, sha256(lang || d.doc_id) as pdf_sha256, sha256(text) as cleaned_text_sha256, length(text) as cleaned_text_length, '' as notes from documents d left join n using (doc_id)")
def _(spark, d):
    b = _books(spark, d).withColumn("year", (1900 + F.col("book_id").cast("long") % 100).cast("int"))
    files = b.select(F.col("source_path").alias("path"), F.sha2(F.concat(F.col("authors")[0], "book_id"), 256).alias("sha256"))
    m = ingest.manifests(b, ingest.passages(b), files)
    return m.select("book_id", "title", F.col("authors")[0].alias("author"), "year", "source_path", "extraction_mode", "split_method", "num_chunks", "pdf_sha256", "cleaned_text_sha256", F.col("cleaned_text_length").cast("long").alias("cleaned_text_length"), "notes")


_STATUS = "select case when doc_id % 7 = 0 then 'failed' when doc_id % 3 = 0 then 'skipped' else 'success' end as status from documents"


@query("snk7_agg11_status_counts", f"select count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed, count(*) as total from ({_STATUS})")
def _(spark, d):
    s = F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("success")
    return ingest.status_counts(docs(spark, d).select(s.alias("status")))


# --- text

@query("txt1_nfc", "select doc_id, sha256(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) as h from documents")
def _(spark, d):
    return docs(spark, d).withColumn("t", T.nfc(F.replace("text", F.lit("e"), F.lit("é")))).select("doc_id", F.sha2("t", 256).alias("h"))


def _hashed(name: str, make, oracle: str) -> None:
    @query(name, f"select doc_id, sha256({oracle}) as h from (select doc_id, replace(replace(text, '. ', '.   '), 'ing', '-' || chr(10) || ' ing') as t from documents)")
    def _(spark, d):
        t = F.replace(F.replace("text", F.lit(". "), F.lit(".   ")), F.lit("ing"), F.lit("-\n ing"))
        return docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.sha2(make(F.col("t")), 256).alias("h"))


_hashed("txt2_collapse_whitespace", T.collapse_spaces, "regexp_replace(t, ' {2,}', ' ', 'g')")
_hashed("txt3_dehyphenate", T.dehyphenate, r"regexp_replace(t, '-\s*\n\s*', '', 'g')")
_hashed("txt5_paragraphs", lambda c: T.paragraphs(F.replace(c, F.lit(".\n"), F.lit(".\n\n\n"))), r"array_to_string(list_filter(list_transform(regexp_split_to_array(replace(t, '.' || chr(10), '.' || chr(10) || chr(10) || chr(10)), '\n\n+'), lambda p: regexp_replace(replace(p, chr(10), ' '), '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))")

_LINES = r"""lines as (select doc_id, i, l[i] as line, regexp_replace(l[i], '^\s+|\s+$', '', 'g') as s from (select doc_id, string_split({t}, chr(10)) as l from {from_}), unnest(range(1, len(l) + 1)) u(i)),
often as (select doc_id, s from lines where length(s) between 1 and 79 group by 1, 2 having count(*) >= 5),
kept as (select l.doc_id, i, case when l.s = '' then '' else line end as line from lines l left join often o on o.doc_id = l.doc_id and o.s = l.s
  where l.s = '' or (o.s is null and not (regexp_matches(l.s, '^[\d\s\-–—]+$') and length(l.s) < 10) and not regexp_matches(l.s, '^(page|p\.)\s*\d+', 'i')))"""


@query("txt4_running_lines", "with src as (select doc_id, text || chr(10) || 'Page 12 of' || chr(10) || ' 12 – 13 ' || chr(10) || repeat('Head' || chr(10), (doc_id % 7)::int) || 'p. 5' as t from documents), " + _LINES.format(t="t", from_="src") + " select src.doc_id, sha256(coalesce(string_agg(line, chr(10) order by i), '')) as h from src left join kept using (doc_id) group by src.doc_id")
def _(spark, d):
    t = F.concat("text", F.lit("\nPage 12 of\n 12 – 13 \n"), F.expr("repeat('Head\\n', cast(doc_id % 7 as int))"), F.lit("p. 5"))
    return docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.sha2(T.drop_running_lines(F.col("t")), 256).alias("h"))


@query("txt6_clean_text", "with src as (select doc_id, regexp_replace(nfc_normalize(text), '-\\s*\\n\\s*', '', 'g') as t from documents), " + _LINES.format(t="t", from_="src") + r""", joined as (select src.doc_id, regexp_replace(coalesce(string_agg(line, chr(10) order by i), ''), ' {2,}', ' ', 'g') as t from src left join kept using (doc_id) group by src.doc_id)
select doc_id, sha256(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\n\n+'), lambda p: regexp_replace(replace(p, chr(10), ' '), '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10)), '^\s+|\s+$', '', 'g')) as h from joined""")
def _(spark, d):
    return T.clean(docs(spark, d)).select("doc_id", F.sha2("cleaned", 256).alias("h"))


_STEM = "case doc_id % 4 when 0 then source || ' - A Book by ' || lang when 1 then 'The Long Title Of ' || source || ' - ' || lang when 2 then 'Story By ' || upper(source) else source end"


def _stem():
    c = F.col("doc_id") % 4
    return F.when(c == 0, F.concat("source", F.lit(" - A Book by "), "lang")).when(c == 1, F.concat(F.lit("The Long Title Of "), "source", F.lit(" - "), "lang")).when(c == 2, F.concat(F.lit("Story By "), F.upper("source"))).otherwise(F.col("source"))


@query("txt7_parse_filename", f"""select doc_id, case when p > 0 then case when len(string_split_regex(trim(left(s, p - 1)), '\\s+')) <= 3 then substring(s, p + 3) else left(s, p - 1) end when q > 0 then trim(left(lower(s), q - 1)) else s end as title,
case when p > 0 then case when len(string_split_regex(trim(left(s, p - 1)), '\\s+')) <= 3 then left(s, p - 1) else substring(s, p + 3) end when q > 0 then trim(substring(lower(s), q + 4)) else 'Unknown' end as author
from (select doc_id, s, instr(s, ' - ') as p, instr(lower(s), ' by ') as q from (select doc_id, {_STEM} as s from documents))""")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.title_and_author(_stem()).alias("x")).select("doc_id", "x.title", "x.author")


@query("txt8_slug", f"select doc_id, left(trim(regexp_replace(lower(s || '__!'), '[^a-z0-9]+', '-', 'g'), '-'), 100) as slug from (select doc_id, {_STEM} as s from documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.slug(F.concat(_stem(), F.lit("__!"))).alias("slug"))


@query("txt9_sha256", "select doc_id, sha256(text) as sha from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("txt10_normalize_entity", "select doc_id, coalesce(regexp_replace(case when doc_id % 5 = 0 then null else '  ' || source || chr(9) end, '^\\s+|\\s+$', '', 'g'), '') as entity from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.entity(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  "), "source", F.lit("\t")))).alias("entity"))


@query("txt11_passage_id", sql("select doc_id, passage_id from passages", "passages"))
def _(spark, d):
    p = A.passages(spark, d)
    return p.select("doc_id", T.passage_id(F.col("book_id"), F.col("chunk_index")).alias("passage_id"))


@query("txt12_contains", "select doc_id, contains(lower(text), 'the') as has from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.mentions(F.col("text"), F.lit("THE")).alias("has"))


@query("txt13_14_prefix_ellipsis", "select doc_id, left(text, 100) as prefix, case when length(text) > 150 then left(text, 150) || '...' else text end as title from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.left("text", F.lit(100)).alias("prefix"), T.ellipsis(F.col("text"), 150).alias("title"))


@query("txt15_16_templates", sql("select ord, subject || ' is bound by ' || lower(replace(relation, '_', ' ')) || ' to {' || object || '}' as sentence from qa", "qa"))
def _(spark, d):
    s = T.filled(F.lit("{subj} is bound by {relation} to {{{obj}}}"), {"subj": F.col("subject"), "obj": F.col("object"), "relation": T.spoken(F.col("relation"))})
    return good(spark, d).select("ord", s.alias("sentence"))


@query("txt17_passage_header", sql("select doc_id, chr(10) || '--- Passage ' || passage_id || ' ---' || chr(10) as header from passages", "passages"))
def _(spark, d):
    return A.passages(spark, d).select("doc_id", T.passage_header(F.col("passage_id")).alias("header"))


# --- chunks

_HEAD = r"""lines as (select doc_id, i, l[i] as s from (select doc_id, string_split(text, chr(10)) as l from chaptered), unnest(range(1, len(l) + 1)) u(i)),
placed as (select *, coalesce(sum(length(s) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from lines),
starts as (select doc_id, row_number() over (partition by doc_id order by i) as chapter, start from placed where regexp_matches(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^(chapter\s+([ivxlcdm]+|\d+)|book\s+([ivxlcdm]+|\d+)|part\s+([ivxlcdm]+|\d+)|\d+\.\s+[a-z])', 'i'))"""


@query("chk1_win3_chapters", f"with chaptered as ({A.CTE['chaptered']}), {_HEAD} select doc_id, chapter, start from starts")
def _(spark, d):
    return chunk.chapter_starts(A.chaptered(spark, d)).select("doc_id", F.col("chapter").cast("long").alias("chapter"), "start")


@query("chk2_split_by_chapters", f"with chaptered as ({A.CTE['chaptered']}), {_HEAD}, ends as (select s.*, coalesce(lead(start) over (partition by s.doc_id order by chapter), length(text)) as stop, text from starts s join chaptered using (doc_id)) select doc_id, chapter, start, stop, sha256(regexp_replace(substring(text, (start + 1)::int, (stop - start)::int), '^\\s+|\\s+$', '', 'g')) as h from ends")
def _(spark, d):
    c = chunk.by_chapters(A.chaptered(spark, d))
    return c.select("doc_id", F.col("chapter").cast("long").alias("chapter"), "start", F.col("end").alias("stop"), F.sha2("text", 256).alias("h"))


@query("chk3_split_by_length", f"with recursive {_walk('documents')} select doc_id, start, stop from walk where regexp_replace(substring(text, (start + 1)::int, (stop - start)::int), '^\\s+|\\s+$', '', 'g') <> ''")
def _(spark, d):
    return chunk.by_length(docs(spark, d)).select("doc_id", "start", F.col("end").alias("stop"))


@query("chk4_5_split_text", f"with recursive chaptered as ({A.CTE['chaptered']}), {_HEAD}, many as (select doc_id from starts group by 1 having count(*) >= 3), rest as (select * from chaptered where doc_id not in (select doc_id from many)), {_walk('rest')} select doc_id, start, 'chapter' as method from starts where doc_id in (select doc_id from many) union all select doc_id, start, 'length' from walk")
def _(spark, d):
    return chunk.split_text(A.chaptered(spark, d)).select("doc_id", "start", "method")


@query("chk6_unnest_responses", sql("select subject, relation, object, confidence, book_id || '_' || (ord % 7) as source_passage_id, book_id from seen where ord % 5 <> 0", "seen"))
def _(spark, d):
    t = A.triples(spark, d)
    t = t.filter(quality.confident(F.col("confidence"))).filter(quality.good_evidence(F.col("evidence_span")))
    said = F.to_json(F.struct(F.array(F.struct("subject", "relation", "object", "confidence", "evidence_span")).alias("triples")))
    r = t.select("book_id", (F.col("ord") % 7).alias("chunk_index"), F.when(F.col("ord") % 5 == 0, "no json {").otherwise(said).alias("response"))
    return model.parsed_triples(r).select("subject", "relation", "object", "confidence", "source_passage_id", "book_id")


@query("chk7_set1_entities", sql("select subject as entity from qa union select object from qa", "qa"))
def _(spark, d):
    return entity.entities(good(spark, d))


@query("chk8_unnest_spans", sql("select person_name, trait_name, s as start, e as stop from spans", "spans"))
def _(spark, d):
    t = A.profiles(spark, d).select("person_name", F.explode("traits").alias("t"))
    return t.select("person_name", "t.trait_name", F.explode("t.evidence_spans").alias("s")).select("person_name", "trait_name", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


# --- filters

@query("flt1_confidence", sql("select ord, confidence from sure", "sure"))
def _(spark, d):
    return A.triples(spark, d).filter(quality.confident(F.col("confidence"))).select("ord", "confidence")


@query("flt2_evidence", sql("select ord from seen", "seen"))
def _(spark, d):
    return A.triples(spark, d).filter(quality.confident(F.col("confidence"))).filter(quality.good_evidence(F.col("evidence_span"))).select("ord")


@query("flt3_self_loops", sql("select ord, subject, object from triples where subject <> object", "triples"))
def _(spark, d):
    return A.triples(spark, d).filter(quality.proper(F.col("subject"), F.col("object"))).select("ord", "subject", "object")


@query("flt4_jon5_span_overlap", sql("select a.person_name, a.trait_name, a.n::int as i, b.n::int as j from spans a join spans b on a.person_name = b.person_name and a.trait_name = b.trait_name and a.n < b.n where greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) > 0 and least(a.k, b.k) > 0 and greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.k, b.k)::double > 0.3", "spans"))
def _(spark, d):
    s = A.profiles(spark, d).select("person_name", F.explode("traits").alias("t")).select("person_name", "t.trait_name", F.posexplode("t.evidence_spans").alias("i", "s"))
    a, b = s.withColumnRenamed("s", "a"), s.withColumnRenamed("s", "b").withColumnRenamed("i", "j")
    return a.join(b, ["person_name", "trait_name"]).filter("i < j").filter(quality.overlap(F.col("a"), F.col("b"))).select("person_name", "trait_name", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"))


@query("flt5_trait_evidence", sql("select t.person_name, t.trait_name from traits t join (select person_name, trait_name from spans group by 1, 2 having count(*) >= 2 and count(*) filter (k >= 50) >= 2) g using (person_name, trait_name) left join clash c on c.person_name = t.person_name and c.trait_name = t.trait_name where c.person_name is null", "traits", "spans", "clash"))
def _(spark, d):
    return A.profiles(spark, d).select("person_name", F.explode(F.filter("traits", lambda t: quality.good_trait(t))).alias("t")).select("person_name", "t.trait_name")


@query("flt6_profile_filter", sql("select person_name, trait_name, round(score, 6) as score, confidence from finals", "finals"))
def _(spark, d):
    return finals(spark, d).select("person_name", F.inline("traits")).select("person_name", "trait_name", F.round("score", 6).alias("score"), "confidence")


@query("flt7_people", sql("select distinct unnest([subject, object]) as entity from qa where relation in ('KNOWS', 'FAMILY_OF', 'FRIENDS_WITH', 'ENEMY_OF', 'LOVES', 'HATES')", "qa"))
def _(spark, d):
    return entity.people(good(spark, d))


@query("flt8_non_characters", "select distinct n as person_name from (select case user_id % 5 when 0 then 'Moon' when 1 then 'HE' else 'U' || user_id end as n from events) where lower(n) not in ('moon', 'he')")
def _(spark, d):
    u = F.col("user_id")
    n = F.when(u % 5 == 0, "Moon").when(u % 5 == 1, "HE").otherwise(F.concat(F.lit("U"), u.cast("string")))
    return entity.characters_only(A.table(spark, d, "events").select(n.alias("person_name")).distinct())


@query("flt9_both_ends", sql("select ord, subject, object from qa where subject in (select 'E' || k from range(0, 200) r(k)) and object in (select 'E' || k from range(0, 200) r(k))", "qa"))
def _(spark, d):
    names = spark.range(200).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("name"))
    return entity.within(good(spark, d), names).select("ord", "subject", "object")


@query("flt11_incremental", "select doc_id from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def _(spark, d):
    f = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    old = f.filter("doc_id % 3 <> 0").select(F.col("path").alias("source_path"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha256")).alias("pdf_sha256"))
    return ingest.to_process(f, old).select("doc_id")


@query("flt12_mapping_confidence", sql("select alias, canonical from aliases where confidence >= 0.65", "aliases"))
def _(spark, d):
    return A.aliases(spark, d).filter(quality.confident(F.col("confidence"))).select("alias", "canonical")


@query("flt13_14_quality_pass", sql("select ord, first_ord, subject, relation, object, confidence, book_id from qa", "qa"))
def _(spark, d):
    return quality.quality_pass(A.triples(spark, d), only_known=True).select("ord", "first_ord", "subject", "relation", "object", "confidence", "book_id")


@query("agg12_pass_counts", sql("select (select count(*) from triples) as initial, (select count(*) from sure) as confident, (select count(*) from seen) as with_evidence, (select count(*) from qa) as final", "qa"))
def _(spark, d):
    seen = Observation()
    final = quality.quality_pass(A.triples(spark, d), observation=seen).count()
    counts = seen.get | {"final": final}
    return spark.createDataFrame([tuple(counts[c] for c in ("initial", "confident", "with_evidence", "final"))], "initial long, confident long, with_evidence long, final long")


# --- joins and sets

_TO = "(select alias, canonical from aliases where confidence >= 0.65)"


@query("jon1_canonicalise", sql(f"select ord, coalesce(a.canonical, subject) as subject, coalesce(b.canonical, object) as object from qa left join {_TO} a on a.alias = subject left join {_TO} b on b.alias = object", "qa", "aliases"))
def _(spark, d):
    return entity.canonicalised(good(spark, d), A.aliases(spark, d)).select("ord", "subject", "object")


@query("jon2_mentions", sql("select doc_id, name from hits", "hits"))
def _(spark, d):
    return profile.mentioning(docs(spark, d), A.names(spark, d), "doc_id")


@query("jon3_nodes_with_traits", sql(f"select id, case when p.person_name is null then 'unknown' else 'person' end as entity_type, {', '.join(f'round(p.{t}, 6) as trait_{t}' for t in TRAITS)} from (select distinct unnest([replace(subject, 'E', 'U'), replace(object, 'E', 'U')]) as id from qa) left join (select person_name, {', '.join(f'max(score) filter (trait_name = {chr(39)}{t}{chr(39)}) as {t}' for t in TRAITS)} from finals group by 1) p on p.person_name = id", "qa", "finals"))
def _(spark, d):
    t = good(spark, d).withColumn("subject", F.replace("subject", F.lit("E"), F.lit("U"))).withColumn("object", F.replace("object", F.lit("E"), F.lit("U")))
    n = graph.nodes(t, finals(spark, d))
    return n.select("id", "entity_type", *(F.round(f"trait_{x}", 6).alias(f"trait_{x}") for x in TRAITS))


@query("jon4_nodes_first_seen", sql("select id, min(o) as ord from (select subject as id, 2 * ord as o from qa union all select object, 2 * ord + 1 from qa) group by id", "qa"))
def _(spark, d):
    return graph.nodes(good(spark, d)).select("id", "ord")


_F1 = "f as (select distinct subject, relation, object from qa where ord % 3 <> 0), t as (select distinct subject, relation, object from qa where ord % 2 = 0), n as (select (select count(*) from f) as nf, (select count(*) from t) as nt, (select count(*) from f join t using (subject, relation, object)) as hit) select round(hit / nf::double, 6) as precision, round(hit / nt::double, 6) as recall, round(2 * (hit / nf::double) * (hit / nt::double) / (hit / nf::double + hit / nt::double), 6) as f1 from n"


@query("jon6_precision_recall", sql("@", "qa").replace("\n@", ", " + _F1))
def _(spark, d):
    t = good(spark, d)
    return metrics.scored(t.filter("ord % 3 <> 0"), t.filter("ord % 2 = 0")).select(*r6("precision", "recall", "f1"))


@query("jon7_trait_error", sql("select count(*) as n, round(avg(abs(score - 0.5)), 6) as mae from finals", "finals"))
def _(spark, d):
    f = finals(spark, d).select("person_name", F.inline("traits")).select("person_name", "trait_name", "score")
    return metrics.trait_error(f, f.withColumn("score", F.lit(0.5))).select("n", *r6("mae"))


_GROUPED = "select case when user_id % 2 = 0 then 'G' || (user_id % 6) else 'U' || user_id end"


def _mapping(spark, d):
    u = F.substring("person_name", 2, 20).cast("long")
    return A.profiles(spark, d).filter(u % 2 == 0).select(F.col("person_name").alias("alias"), F.concat(F.lit("G"), (u % 6).cast("string")).alias("canonical"))


@query("agg9_set2_merge_profiles", sql("select case when u % 2 = 0 then 'G' || (u % 6) else person_name end as person_name, trait_name, max(confidence) as confidence, count(distinct person_name) as n_sources from (select *, substring(person_name, 2)::bigint as u from traits) group by 1, 2", "traits"))
def _(spark, d):
    m = entity.merged_profiles(A.profiles(spark, d), _mapping(spark, d))
    n = A.profiles(spark, d).join(_mapping(spark, d).withColumnRenamed("alias", "person_name"), "person_name", "left").select(F.coalesce("canonical", "person_name").alias("name"), "person_name", F.explode("traits.trait_name").alias("trait_name")).groupBy("name", "trait_name").agg(F.count_distinct("person_name").alias("n_sources"))
    t = m.select(F.col("person_name").alias("name"), F.inline("traits")).join(n, ["name", "trait_name"])
    return t.select(F.col("name").alias("person_name"), "trait_name", "confidence", "n_sources")


@query("agg10_case_mapping", sql("select alias, case when low = 'e4' then 'By Hand' else first(alias) over (partition by low order by length(alias) desc, n desc, alias) end as canonical from (select alias, lower(alias) as low, n, count(*) over (partition by lower(alias)) as variants from (select alias, count(*) as n from (select case when ord % 3 = 0 then lower(subject) else subject end as alias from qa union all select object from qa) group by 1)) where variants >= 2", "qa"))
def _(spark, d):
    t = good(spark, d).withColumn("subject", F.when(F.col("ord") % 3 == 0, F.lower("subject")).otherwise(F.col("subject")))
    return entity.case_mapping(t, spark.createDataFrame([("E4", "By Hand")], "alias string, canonical string"))


@query("set3_neighbourhood", sql("select src, dst, key from edges where src in (select id from keep) and dst in (select id from keep)", "edges").replace("\nselect", ", named as (select 'E' || k as id from range(0, 60) r(k)), keep as (select id from named union select dst from edges where src in (select id from named) and substring(dst, 2)::int % 4 = 0)\nselect"))
def _(spark, d):
    t = good(spark, d)
    n = graph.nodes(t).withColumn("entity_type", F.when(F.substring("id", 2, 9).cast("int") % 4 == 0, "person").otherwise("unknown"))
    named = spark.range(60).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("id"))
    return graph.neighbourhood(graph.edges(t), n, named).select("src", "dst", "key")


@query("set4_books_union", sql("select book_id, count(*) as n from triples group by 1", "triples"))
def _(spark, d):
    t = A.triples(spark, d)
    one = t.filter("book_id like '1%'")
    return one.unionByName(t.filter("book_id not like '1%'")).groupBy("book_id").agg(F.count("*").alias("n"))


# --- aggregates and ranks

@query("agg1_dedup", sql("select ord, subject, relation, object, confidence from qa", "qa"))
def _(spark, d):
    return good(spark, d).select("ord", "subject", "relation", "object", "confidence")


@query("agg2_triple_stats", sql("select count(*) as n_triples, round(avg(confidence), 6) as avg_confidence, min(confidence) as min_confidence, max(confidence) as max_confidence, count(distinct relation) as n_relations from qa", "qa"))
def _(spark, d):
    return metrics.triple_stats(good(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("agg3_evidence_quality", sql("select count(nullif(ev_text, '')) / count(*)::double as coverage, round(avg(length(ev_text)), 6) as avg_length, round(count(distinct left(ev_text, 100)) / count(*)::double, 6) as diversity from qa", "qa"))
def _(spark, d):
    return metrics.evidence_quality(good(spark, d)).select(F.col("coverage").cast("double").alias("coverage"), *r6("avg_length", "diversity"))


@query("agg4_confidence_bins", sql("select count(*) filter (confidence < .5) as bin_0, count(*) filter (confidence >= .5 and confidence < .7) as bin_1, count(*) filter (confidence >= .7 and confidence < .85) as bin_2, count(*) filter (confidence >= .85 and confidence < .95) as bin_3, count(*) filter (confidence >= .95) as bin_4, round(avg(confidence), 6) as mean, round(stddev_pop(confidence), 6) as std from triples", "triples"))
def _(spark, d):
    return metrics.confidence_distribution(A.triples(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_DIV = "c as (select relation, count(*)::double as c from qa group by 1), s as (select c, row_number() over (order by c, relation) as i, sum(c) over () as total, count(*) over () as k from c) select max(k) as n_relations, round(sum(-(c / total) * log2(c / total)), 6) as entropy, round(sum(-(c / total) * log2(c / total)) / log2(max(k)), 6) as normalized_entropy, round(2 * sum(i * c) / (max(k) * max(total)) - (max(k) + 1) / max(k), 6) as gini from s"


@query("agg5_6_relation_diversity", sql("@", "qa").replace("\n@", ", " + _DIV))
def _(spark, d):
    return metrics.relation_diversity(good(spark, d)).select("n_relations", *r6("entropy", "normalized_entropy", "gini"))


@query("agg7_personality_stats", sql("select t as trait_name, round(coalesce(avg(score), 0), 6) as avg_score from (select unnest(['openness', 'conscientiousness', 'extraversion', 'agreeableness', 'neuroticism']) as t) left join finals on trait_name = t group by t", "finals"))
def _(spark, d):
    return metrics.personality_stats(finals(spark, d)).select("trait_name", *r6("avg_score"))


@query("agg8_personality_quality", sql("select count(*) as n_profiles, round(sum(sp) / sum(k)::double, 6) as spans_per_trait, round(count(*) filter (k = 5) / count(*)::double, 6) as complete_share, round(avg(sd) filter (k >= 2), 6) as confidence_std from (select person_name, count(*) as k, sum(n_spans) as sp, stddev_pop(confidence) as sd from finals group by 1)", "finals"))
def _(spark, d):
    return metrics.personality_quality(finals(spark, d)).select("n_profiles", *r6("spans_per_trait", "complete_share", "confidence_std"))


@query("top1_relations", sql("select relation, n from (select relation, count(*) as n, min(ord) as f from qa group by 1) order by n desc, f limit 10", "qa"))
def _(spark, d):
    return metrics.top_relations(good(spark, d))


@query("top2_nodes", sql("select id, degree from deg join (select id, min(o) as o from (select src as id, 2 * ord as o from edges union all select dst, 2 * ord + 1 from edges) group by 1) using (id) order by degree desc, o limit 10", "deg"))
def _(spark, d):
    t = good(spark, d)
    return graph.top_nodes(graph.edges(t), graph.nodes(t))


@query("lim1_first_per_book", sql("select doc_id from passages where chunk_index < 7", "passages"))
def _(spark, d):
    return quality.first_per_book(A.passages(spark, d), 7).select("doc_id")


@query("lim2_first_people", sql("select entity from (select distinct unnest([subject, object]) as entity from qa where relation in ('KNOWS', 'FAMILY_OF', 'FRIENDS_WITH', 'ENEMY_OF', 'LOVES', 'HATES')) order by entity limit 5", "qa"))
def _(spark, d):
    return entity.people(good(spark, d)).orderBy("entity").limit(5)


@query("lim3_first_ids", sql("select name, array_to_string(list(passage_id order by doc_id), ',') as ids from (select * from hits qualify row_number() over (partition by name order by doc_id) <= 100) group by name", "hits"))
def _(spark, d):
    hits = _hits(spark, d).withColumn("ord", F.col("doc_id"))
    return profile.first_ids(hits).select("name", F.array_join("source_passage_ids", ",").alias("ids"))


def _hits(spark, d):
    """Hits with their texts' lengths: a text has a hit for each name in it."""
    p = A.passages(spark, d, F.length("text"), "chars").select("doc_id", "chunk_index", "passage_id", "chars")
    return profile.mentioning(docs(spark, d), A.names(spark, d), "doc_id").join(p, "doc_id")


@query("win1_even_sampling", sql("select name, passage_id, i::bigint as rank from even", "even"))
def _(spark, d):
    return profile.evenly_sampled(_hits(spark, d)).select("name", "passage_id", "rank")


@query("win2_context_budget", sql("select name, passage_id, used::bigint as used from used where used <= 12000", "used"))
def _(spark, d):
    return profile.within_budget(profile.evenly_sampled(_hits(spark, d))).select("name", "passage_id", "used")


@query("win4_edge_keys", sql("select ord, src, dst, key from edges", "edges"))
def _(spark, d):
    return edges(spark, d).select("ord", "src", "dst", "key")


# --- graph

@query("g1_graph", sql("select src, dst, key, relation, confidence, evidence from edges", "edges"))
def _(spark, d):
    return edges(spark, d).select("src", "dst", "key", "relation", "confidence", "evidence")


@query("g2_g3_g9_totals", sql("select *, case when density < .01 then 'very_sparse' when density < .05 then 'sparse' when density < .2 then 'moderate' else 'dense' end as density_label from (select count(*) as n_nodes, (sum(degree) / 2)::bigint as n_edges, round(avg(degree), 6) as avg_degree, max(degree) as max_degree, round((sum(degree) / 2) / (count(*) * (count(*) - 1))::double, 6) as density from deg)", "deg"))
def _(spark, d):
    return graph.totals(edges(spark, d)).withColumn("avg_degree", F.round("avg_degree", 6)).withColumn("density", F.round("density", 6))


@query("g3_degrees", sql("select id, degree from deg", "deg"))
def _(spark, d):
    return graph.degrees(edges(spark, d))


@query("g4_components", sql("select id, component from comp", "comp"))
def _(spark, d):
    return graph.components(edges(spark, d))


_PATHS = "largest as (select id from comp where component = (select component from comp group by 1 order by count(*) desc, component limit 1)), walk(src, dst, dist) using key (src, dst) as (select id, id, 0 from largest union select walk.src, ways.b, min(walk.dist) + 1 from walk join ways on walk.dst = ways.a where not exists (select 1 from recurring.walk old where old.src = walk.src and old.dst = ways.b) group by walk.src, ways.b), best as (select * from walk where src <> dst)"


@query("g5_g6_paths", sql("@", "comp").replace("\n@", ", " + _PATHS + " select round(avg(dist), 6) as avg_path_length, max(dist)::bigint as diameter from best"))
def _(spark, d):
    return graph.path_measures(edges(spark, d)).withColumn("avg_path_length", F.round("avg_path_length", 6))


_CLUSTERED = "select id, coalesce(k, 0) as degree, coalesce(t, 0) as triangles, coalesce(2.0::double * t / nullif(k * (k - 1), 0), 0) as clustering from deg left join (select a as id, count(*) as k from ways group by 1) using (id) left join (select x.a as id, count(*) as t from ways x join ways y on x.a = y.a and x.b < y.b join pairs p on p.a = x.b and p.b = y.b group by 1) using (id)"


@query("g7_clustering", sql(f"select * replace (round(clustering, 6) as clustering) from ({_CLUSTERED})", "deg", "ways"))
def _(spark, d):
    return graph.clustering(edges(spark, d)).withColumn("clustering", F.round("clustering", 6))


@query("g8_assortativity", sql("select round(corr(o, i), 6) as assortativity from edges join (select src, count(*)::double as o from edges group by 1) using (src) join (select dst, count(*)::double as i from edges group by 1) using (dst)", "edges"))
def _(spark, d):
    return graph.assortativity(edges(spark, d)).select(*r6("assortativity"))


_LISTS = """top_relations as (select relation, count(*) as n from qa group by 1 order by n desc, min(ord) limit 10),
top_nodes as (select id, degree from deg join (select id, min(o) as o from (select src as id, 2 * ord as o from edges union all select dst, 2 * ord + 1 from edges) group by 1) using (id) order by degree desc, o limit 10),
persons as (select person_name, count(*) as k, sum(n_spans) as sp, stddev_pop(confidence) as sd from finals group by 1),
c as (select relation, count(*)::double as c from qa group by 1), s as (select c, row_number() over (order by c, relation) as i, sum(c) over () as total, count(*) over () as k from c)"""
_METRICS = {
    "triples": "count(*)::double as n_triples, avg(confidence) as avg_confidence, min(confidence) as min_confidence, max(confidence) as max_confidence, count(distinct relation)::double as n_relations from qa",
    "evidence": "count(nullif(ev_text, '')) / count(*)::double as coverage, avg(length(ev_text)) as avg_length, count(distinct left(ev_text, 100)) / count(*)::double as diversity from qa",
    "confidence": "count(*) filter (confidence < .5)::double as bin_0, count(*) filter (confidence >= .5 and confidence < .7)::double as bin_1, count(*) filter (confidence >= .7 and confidence < .85)::double as bin_2, count(*) filter (confidence >= .85 and confidence < .95)::double as bin_3, count(*) filter (confidence >= .95)::double as bin_4, avg(confidence) as mean, stddev_pop(confidence) as std from qa",
    "relations": "max(k)::double as n_relations, sum(-(c / total) * log2(c / total)) as entropy, sum(-(c / total) * log2(c / total)) / log2(max(k)) as normalized_entropy, 2 * sum(i * c) / (max(k) * max(total)) - (max(k) + 1) / max(k) as gini from s",
    "personality": "count(*)::double as n_profiles, sum(sp) / sum(k)::double as spans_per_trait, count(*) filter (k = 5) / count(*)::double as complete_share, avg(sd) filter (k >= 2) as confidence_std from persons",
    "graph": "count(*)::double as n_nodes, sum(degree)::double / 2 as n_edges, avg(degree) as avg_degree, max(degree)::double as max_degree, (sum(degree) / 2) / (count(*) * (count(*) - 1))::double as density from deg",
    "graph_quality": "(select count(distinct component)::double from comp) as n_components, (select max(n)::double from (select count(*) as n from comp group by component)) as largest_component, (select avg(clustering) from clustered) as avg_clustering, (select corr(o, i) from edges join (select src, count(*)::double as o from edges group by 1) using (src) join (select dst, count(*)::double as i from edges group by 1) using (dst)) as assortativity, (select avg(dist) from best) as avg_path_length, (select max(dist)::double from best) as diameter",
}
_ROWS = [f"select '{k}' as section, name as metric, round(value, 6) as value from (unpivot (select {v}) on columns(*) into name name value value)" for k, v in _METRICS.items()]
_ROWS += [f"select 'top_relations', relation, n::double from top_relations", "select 'most_connected', id, degree::double from top_nodes", "select 'personality_stats', t, round(coalesce(avg(score), 0), 6) from (select unnest(['openness', 'conscientiousness', 'extraversion', 'agreeableness', 'neuroticism']) as t) left join finals on trait_name = t group by t"]


@query("g10_evaluate", sql("@", "qa", "comp", "finals").replace("\n@", f", {_PATHS}, clustered as ({_CLUSTERED}), {_LISTS} " + " union all ".join(_ROWS)))
def _(spark, d):
    """Every section of the evaluation."""
    t = good(spark, d)
    out = metrics.evaluated(t, finals(spark, d), graph.edges(t), graph.nodes(t))
    return out.withColumn("value", F.round("value", 6))


# --- visual encodings

@query("viz1_2_6_nodes", sql("select id, round(15 + degree / max(degree) over ()::double * 40, 6) as size, '#9aa0a6' as colour, 0.8::double as avg_confidence, 0.9::double as opacity, 3::bigint as border, false as has_personality from deg", "deg"))
def _(spark, d):
    t = good(spark, d)
    v = viz.viz_nodes(graph.nodes(t), graph.edges(t))
    return v.select("id", F.round("size", 6).alias("size"), "colour", F.col("avg_confidence").cast("double").alias("avg_confidence"), F.round("opacity", 6).cast("double").alias("opacity"), "border", "has_personality")


@query("viz3_trait_bands", sql("select person_name, trait_name, case when score >= .7 then 'high' when score >= .5 then 'medium' else 'low' end as level, floor(score * 100)::bigint as bar from finals", "finals"))
def _(spark, d):
    t = finals(spark, d).select("person_name", F.inline("traits"))
    return t.select("person_name", "trait_name", viz.band(F.col("score")).alias("level"), viz.bar(F.col("score")).alias("bar"))


@query("viz4_5_edges", sql("select src, dst, key, case when relation in ('LOVES', 'FRIENDS_WITH', 'FAMILY_OF') then 'positive' when relation in ('ENEMY_OF', 'HATES') then 'negative' when relation in ('LEADS', 'OWNS', 'CREATED') then 'leadership' else 'neutral' end as polarity, round(.5 + 3.5 * confidence, 6) as width, confidence < .7 as dashed, round(.4 + .6 * confidence, 6) as opacity, case when confidence >= .7 then relation else '' end as label from edges", "edges"))
def _(spark, d):
    return viz.viz_edges(edges(spark, d)).select("src", "dst", "key", "polarity", *r6("width"), "dashed", *r6("opacity"), "label")


# --- synthetic data and models

@query("syn1_5_passages")
def _(spark, d):
    return synth.passages(spark, 200).select("passage_id", "text", F.size("triples").alias("n_triples"), F.size("featured").alias("n_people"))


def _told(spark, d):
    """The triples of each order as a story, with names of two words."""
    named = lambda c: F.concat(F.lit("Entity "), c)
    t = A.triples(spark, d).select("ord", F.col("source").cast("string").alias("book_id"), F.lit(0).alias("chunk_index"), named("subject").alias("subject"), "relation", named("object").alias("object"))
    return synth.told(t)


@query("llm1_extract", sql("select source::varchar as book_id, 'Entity ' || subject as subject, relation, 'Entity ' || object as object, count(*) as n from triples group by all", "triples"))
def _(spark, d):
    return model.extract(_told(spark, d)).groupBy("book_id", "subject", "relation", "object").agg(F.count("*").alias("n"))


_F2 = "f as (select distinct subject, relation, object from triples), t as (select distinct subject, relation, object from qa), n as (select (select count(*) from f) as nf, (select count(*) from t) as nt, (select count(*) from f join t using (subject, relation, object)) as hit) select round(hit / nf::double, 6) as precision, round(hit / nt::double, 6) as recall, round(2 * hit / (nf + nt)::double, 6) as f1 from n"


@query("llm1_extraction_score", sql("@", "qa").replace("\n@", ", " + _F2))
def _(spark, d):
    """What is read back of the stories of all triples, held against those that pass the quality filters."""
    found = model.extract(_told(spark, d)).select(F.substring_index("subject", " ", -1).alias("subject"), "relation", F.substring_index("object", " ", -1).alias("object"))
    return metrics.scored(found, good(spark, d)).select(*r6("precision", "recall", "f1"))


@query("llm2_canonicalise", sql("select alias, min(alias) over (partition by lower(alias)) as canonical from (select distinct alias from (select case when ord % 3 = 0 then lower(subject) else subject end as alias from qa union all select object from qa)) qualify alias <> canonical", "qa"))
def _(spark, d):
    t = good(spark, d).withColumn("subject", F.when(F.col("ord") % 3 == 0, F.lower("subject")).otherwise(F.col("subject")))
    return model.canonicalise(entity.entities(t)).select("alias", "canonical")


@query("llm3_profiles")
def _(spark, d):
    people = spark.createDataFrame([(c,) for c in synth.world().people], "name string")
    p = synth.passages(spark, 200)
    hits = profile.mentioning(p, people).join(p.drop("text"), "passage_id")
    return model.infer_profiles(profile.contexts(profile.with_texts(profile.evenly_sampled(hits), p))).select("person_name", F.inline("traits")).select("person_name", "trait_name", "score", F.size("evidence_spans").alias("n_spans"))


# --- analyses

@query("n1_top_profiles", sql("select person_name, k, round(s, 6) as avg_score from (select person_name, count(*) as k, avg(score) as s from finals group by 1) order by k desc, person_name limit 10", "finals"))
def _(spark, d):
    s = F.aggregate("traits", F.lit(0.0), lambda a, t: a + t["score"]) / F.size("traits")
    return finals(spark, d).select("person_name", F.size("traits").cast("long").alias("k"), F.round(s, 6).alias("avg_score")).orderBy(F.desc("k"), "person_name").limit(10)


@query("n2_top_relations", sql("select relation, n from (select relation, count(*) as n, min(ord) as f from qa group by 1) order by n desc, f limit 15", "qa"))
def _(spark, d):
    return metrics.top_relations(good(spark, d), 15)


@query("n3_confidence_quartiles", sql("select round(quantile_cont(confidence, .25), 6) as q1, round(quantile_cont(confidence, .5), 6) as q2, round(quantile_cont(confidence, .75), 6) as q3 from triples", "triples"))
def _(spark, d):
    return A.triples(spark, d).agg(*(F.round(F.percentile("confidence", q), 6).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))


@query("n4_trait_distribution", sql("select trait_name, count(*) as n, round(min(score), 6) as low, round(avg(score), 6) as mean, round(max(score), 6) as high from traits group by 1", "traits"))
def _(spark, d):
    t = A.profiles(spark, d).select(F.inline("traits"))
    return t.groupBy("trait_name").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("high"))


@query("n5_ego_networks", sql("select src, dst, key from edges where src in (select id from top) or dst in (select id from top)", "deg").replace("\nselect", ", top as (select id from deg join (select id, min(o) as o from (select src as id, 2 * ord as o from edges union all select dst, 2 * ord + 1 from edges) group by 1) using (id) order by degree desc, o limit 5)\nselect"))
def _(spark, d):
    t = good(spark, d)
    e = graph.edges(t)
    return graph.ego(e, graph.top_nodes(e, graph.nodes(t), 5)).select("src", "dst", "key")


@query("n6_degree_distribution", sql("select degree, count(*) as n from deg group by 1", "deg"))
def _(spark, d):
    return graph.degrees(edges(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


@query("n7_latest_run", "select source as novel, max_by(doc_id, n_chars * 1000000 + doc_id) as run from documents group by 1")
def _(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("novel")).agg(F.max_by("doc_id", F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("run"))


@query("n8_per_book", sql("select book_id, count(*) as n, count(distinct subject) as subjects, count(distinct relation) as relations from qa group by 1", "qa"))
def _(spark, d):
    return good(spark, d).groupBy("book_id").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("relation").alias("relations"))
