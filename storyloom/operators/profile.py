"""Which passages mention whom, and the context a profile is inferred from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import mentions, passage_header
from storyloom.operators.tables import ranked

#: Names up to this many are searched in one pass of an automaton, which tasks hold in memory.
NAMES_AT_ONCE = 100_000


def mentioning(passages: DataFrame, names: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """(key, name): passages whose text holds a name, in any case.

    Names are searched all at once by an Aho-Corasick automaton in Arrow batches: a
    passage is read once, not once for each name. Up to NAMES_AT_ONCE names, which are counted first, go to the tasks;
    where there are more, ``mentioning_by_words`` takes over.
    """
    names = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct()
    some = names.limit(NAMES_AT_ONCE + 1).toArrow()["name"].to_pylist()
    if len(some) > NAMES_AT_ONCE:
        return mentioning_by_words(passages, names, key, text)
    import ahocorasick

    block = passages.sparkSession.sparkContext.broadcast(some)
    kind = passages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for n in block.value:
            found.add_word(n.lower(), [*found.get(n.lower(), []), n])
        found.make_automaton()
        for b in batches:
            keys, hits = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and len(found):
                    got = {n for _, ns in found.iter(t.lower()) for n in ns}
                    keys += [k] * len(got)
                    hits += sorted(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.types[0]), pa.array(hits, pa.string())], ["key", "name"])

    return passages.select(key, text).mapInArrow(run, f"key {kind}, name string").withColumnRenamed("key", key)


def mentioning_by_words(passages: DataFrame, names: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """The same for any number of names, as joins: a passage and a name meet where a stretch of the text has the hash of the name's
    first characters; the names found so are then looked for whole. Names are dealt by how many characters begin them: 1, 2, 4 or 8."""
    n = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct().withColumn("_low", F.lower("name"))
    n = n.withColumn("_size", F.when(F.length("_low") >= 8, 8).when(F.length("_low") >= 4, 4).when(F.length("_low") >= 2, 2).otherwise(1)).withColumn("_start", F.substring("_low", F.lit(1), F.col("_size")))
    p = passages.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).filter("_text <> ''")
    starts = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 4, 8))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - k + 1, F.lit(1))), lambda i: F.substring("_text", i, k))))
    found = p.select("_key", F.explode(F.array_distinct(starts)).alias("_start")).join(n, "_start").select("_key", "name", "_low").distinct()
    return found.join(p, "_key").filter(F.contains("_text", "_low")).select(F.col("_key").alias(key), "name").distinct()


def mentioning_by_join(passages: DataFrame, names: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """The same as a join on the containment itself, for few names."""
    n = names.select(F.col(names.columns[0]).alias("name")).distinct()
    return passages.join(n, mentions(F.col(text), F.col("name"))).select(key, "name")


def evenly_sampled(hits: DataFrame, most: int = 50, by: str = "name") -> DataFrame:
    """At most ``most`` passages for each name, at even steps in order of chunk.

    A passage has a hit for each name in it, so hits should come without their texts: their columns are ranked as they are, and
    ``with_texts`` joins what is left of them. Texts that do come are joined with all hits.
    """
    thin = hits.drop("text").withColumn("_chunk", F.coalesce("chunk_index", F.lit(0)))
    x = ranked(thin, by, ["_chunk", "passage_id"], "rank", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most)).cast("long")
    kept = x.filter((F.col("_n") <= most) | ((F.col("rank") % step == 0) & (F.col("rank") < step * most))).drop("_chunk", "_n")
    return hits.join(kept.select(by, "passage_id", "rank"), [by, "passage_id"]) if "text" in hits.columns else kept


def with_texts(sampled: DataFrame, passages: DataFrame) -> DataFrame:
    return sampled.join(passages.select("passage_id", "text"), "passage_id")


def within_budget(sampled: DataFrame, most_chars: int = 12000, by: str = "name") -> DataFrame:
    """The leading passages whose headers and texts fit; the first that doesn't ends the context. ``chars``, the length of a text, may stand for it."""
    size = F.length(passage_header(F.col("passage_id"))) + (F.length("text") if "text" in sampled.columns else F.col("chars"))
    used = F.sum(size).over(W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return sampled.withColumn("used", used).filter(F.col("used") <= most_chars)


def contexts(sampled: DataFrame, most_chars: int = 12000, by: str = "name") -> DataFrame:
    """(name, context): bounded by ``most_chars``."""
    part = F.struct("rank", F.concat(passage_header(F.col("passage_id")), F.col("text")).alias("t"))
    return within_budget(sampled, most_chars, by).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "\n").alias("context"))


def first_ids(hits: DataFrame, most: int = 100, by: str = "name") -> DataFrame:
    x = hits.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("ord"))).filter(F.col("_n") <= most)
    return x.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "passage_id"))), lambda p: p["passage_id"]).alias("source_passage_ids"))
