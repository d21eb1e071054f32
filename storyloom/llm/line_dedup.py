"""Line dedup over a corpus, in Spark's own functions only.

A line's key is the line without white space at both ends and with A-Z lower-cased.
Keys of at least ``min_chars`` code points held by at least ``min_docs`` documents
lose all their lines, except in the largest ``doc_id`` that holds them.

Only 128-bit hashes, document ids and positions move: they are range-partitioned by
(hash, document), so that a line of half the corpus is spread over many tasks, and
sorted by document and position; each partition streams the first occurrence in each
document and sums them before the sums of a key meet; the sums of a key go back to its lines in parts dealt by document. What comes back is a
compressed keep bitmap for each document (runs of kept lines), not text.

Defined cases: a null or empty text is one empty line; rows with the same ``doc_id``
count as one document, and each keeps a result of its own; a null ``doc_id`` is one
document, smaller than every other; an empty table gives an empty result. Extra
columns pass through ``dedup_lines``; only names that begin with ``_ld_`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, ascii_lower, documents, key128, text_of
from storyloom.llm.graph import salt_of

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def hashed_lines(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ld_h1, _ld_h2, doc_id, _ld_text, _ld_pos) of each line with a long enough key."""
    d = df.select("doc_id", F.xxhash64(text_of()).alias("_ld_text"), F.posexplode(F.split(text_of(), "\n")).alias("_ld_pos", "_ld_line"))
    d = d.withColumn("_ld_line", line_key(F.col("_ld_line"))).filter(F.length("_ld_line") >= min_chars)
    h1, h2 = key128(ascii_lower(F.col("_ld_line")))
    return d.select(h1.alias("_ld_h1"), h2.alias("_ld_h2"), "doc_id", "_ld_text", "_ld_pos")


def dropped_runs(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, _ld_text, _ld_runs, n_dropped) of each document that loses lines; runs are (first line, number of lines)."""
    key = ["_ld_h1", "_ld_h2"]
    rows = hashed_lines(df, min_chars).repartitionByRange(*key, "doc_id").sortWithinPartitions(*key, "doc_id", "_ld_text", "_ld_pos")
    first = F.row_number().over(W.partitionBy(*key, "doc_id").orderBy("_ld_text", "_ld_pos")) == 1
    salt = salt_of("doc_id", df)  # a key of half the corpus meets its sums in as many parts
    parts = rows.withColumn("_ld_first", first).filter("_ld_first").groupBy(*key, salt.alias("_ld_salt")).agg(F.count("*").alias("_ld_docs"), F.max("doc_id").alias("_ld_holder"))
    shared = parts.groupBy(*key).agg(F.sum("_ld_docs").alias("_ld_docs"), F.max("_ld_holder").alias("_ld_holder")).filter(F.col("_ld_docs") >= min_docs).drop("_ld_docs")
    shared = parts.select(*key, "_ld_salt").join(shared, key)
    gone = rows.withColumn("_ld_salt", salt).join(shared, [*key, "_ld_salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("_ld_holder")))
    at = gone.groupBy("doc_id", "_ld_text").agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_at"))
    p = F.col("_ld_at")
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, F.greatest(i - 1, F.lit(0))) != x - 1))
    ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
    return at.select("doc_id", "_ld_text", F.size(p).alias("_ld_gone"), F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("at"), (e - s + 1).alias("n"))).alias("_ld_runs"))


def _kept_runs(n_lines: Column, gone: Column) -> Column:
    """The complement of runs within all lines."""
    none = F.array().cast("array<int>")
    gone = F.coalesce(gone, F.array().cast("array<struct<at:int,n:int>>"))
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["at"] + r["n"]))
    nexts = F.concat(F.coalesce(F.transform(gone, lambda r: r["at"]), none), F.array(n_lines))
    return F.filter(F.zip_with(ends, nexts, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))), lambda r: r["n"] > 0)


def keep_bitmaps(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of ``df`` with n_lines, n_dropped and ``keep_runs``: the compressed keep bitmap, as (first line, number of lines).
    Columns of these names that came are replaced."""
    gone = dropped_runs(df, min_chars, min_docs).withColumnRenamed("doc_id", "_ld_doc").withColumnRenamed("_ld_text", "_ld_of")
    rows = df.withColumn("_ld_text", F.xxhash64(text_of()))
    out = rows.join(gone, rows["doc_id"].eqNullSafe(F.col("_ld_doc")) & (F.col("_ld_text") == F.col("_ld_of")), "left")
    n = F.size(F.split(text_of(), "\n"))
    return out.select(*(out[c] for c in df.columns if c not in ("n_lines", "n_dropped", "keep_runs")), n.cast("long").alias("n_lines"), F.coalesce("_ld_gone", F.lit(0)).cast("long").alias("n_dropped"), _kept_runs(n, F.col("_ld_runs")).alias("keep_runs"))


def kept_text(text: Column, runs: Column) -> Column:
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(F.split(text, "\n"), r["at"] + 1, r["n"]))), "\n")


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows and columns that came, each text without its dropped lines; texts that lose none stay as they are, nulls too."""
    kept = keep_bitmaps(df.withColumns({f"_ld_in_{c}": F.col(c) for c in ("n_lines", "n_dropped", "keep_runs") if c in df.columns}), min_chars, min_docs)
    text = F.when(F.col("n_dropped") > 0, kept_text(text_of(), F.col("keep_runs"))).otherwise(F.col("text"))
    return kept.withColumn("text", text).select(*(F.col(f"_ld_in_{c}" if c in ("n_lines", "n_dropped", "keep_runs") else c).alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keep_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.when(F.col("n_dropped") > 0, kept_text(text_of(), F.col("keep_runs"))).otherwise(text_of())
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
l as (select doc_id, i, l[i] as line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from d, unnest(range(1, len(l) + 1)) u(i)),
s as (select k, max(doc_id) as holder from l where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}),
x as (select l.*, s.k is not null and l.doc_id <> s.holder as gone from l left join s on l.k = s.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from x group by doc_id
"""
