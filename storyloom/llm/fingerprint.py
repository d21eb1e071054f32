"""Document fingerprints: bottom-k sketches of word-shingle hashes, in Spark's own functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's shingles of five words (a text of one to four words has one shingle of all of
them; a text without words has none). Two sketches merge into the sketch of the union
(``merge``, ``merge_groups``), and give the estimated resemblance, containment and
number of distinct shingles. Below ``k`` distinct shingles all estimates are exact.

Defined cases: a null text counts as the empty one; two empty sketches resemble each
other fully (1.0), an empty and another not at all; equal texts have equal
fingerprints; a null ``doc_id`` orders after every other; repeated rows give one
result each and are ordered by their text; an empty table gives an empty result.
Extra columns are not read; ``with_next`` passes them on, but for names that begin with ``_fp_``, which it takes, and those of the
``next_`` columns, which it adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.llm.common import documents, text_of, word_array

SHINGLE = 5
K = 256


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """``words`` must be a plain column: it is used n times for each shingle."""
    return F.transform(F.slice(words, 1, F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - (n - 1), F.lit(1)))), lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, n))))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    return df.withColumn(out, word_array(text_of(text))).withColumn(out, smallest(shingle_hashes(F.col(out)), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; beyond, from how densely the k smallest hashes lie."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has too."""
    joint = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def merge_groups(df: DataFrame, by: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One merged sketch for each group. A group of any size is split: hashes are made distinct where they are read, each of ``salts`` parts of a group keeps its k smallest, and only those meet."""
    h = df.select(*by, F.explode(sketch).alias("_h")).distinct().withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    for part in (["_salt"], []):
        h = h.withColumn("_n", F.row_number().over(W.partitionBy(*by, *part).orderBy("_h"))).filter(F.col("_n") <= k).drop("_n")
    return h.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_string(sketch: Column) -> Column:
    """All hashes of a sketch, 16 hex digits each, packed in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(df: DataFrame, key: str, text: str, carry: list[str], parts: int | None = None, compute=None) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the row next in descending key, after the last the first.

    Rows are dealt to blocks of adjacent keys, whose bounds are quantiles (``parts``
    numbers, all that the driver holds), and looked up within a block. The first
    row of each block is also sent to the block before, as that one's end, so that no
    row needs another block. The text moves once.
    """
    spark = df.sparkSession
    n = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_of = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    at = df.agg(F.percentile_approx(key_of, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(at or []))
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    rough = F.lit(bounds[step - 1 :: step]) if bounds else fine

    def block(x: Column) -> Column:
        full = F.size(F.filter(rough, lambda b: b <= x)) * step  # bounds are searched in two steps of about their root
        return full + F.size(F.filter(F.slice(fine, full + 1, step), lambda b: b <= x))

    rows = df.withColumn("_fp_key", key_of).withColumn("_fp_block", block(F.col("_fp_key")))
    heads = sorted((r["_fp_block"], r["head"]) for r in rows.groupBy("_fp_block").agg(F.max("_fp_key").alias("head")).collect())
    ends = [(h, heads[(i + 1) % len(heads)][0]) for i, (_, h) in enumerate(heads)]
    ends_df = spark.createDataFrame(ends, "_fp_head long, _fp_to int")
    rows = rows.join(F.broadcast(ends_df), F.col("_fp_key") == F.col("_fp_head"), "left").drop("_fp_head")
    places = F.array_compact(F.array(F.struct(F.col("_fp_block").alias("at"), F.lit(0).alias("end")), F.when(F.col("_fp_to").isNotNull(), F.struct(F.col("_fp_to").alias("at"), F.lit(1).alias("end")))))
    rows = rows.withColumn("_fp_place", F.explode(places)).select("*", F.col("_fp_place.at").cast("int").alias("_fp_at"), F.col("_fp_place.end").alias("_fp_end"))
    rows = rows.repartitionById(len(bounds) + 1, F.col("_fp_at"))  # each block is one task's
    if compute is not None:
        rows = compute(rows)
    w = W.partitionBy("_fp_at").orderBy("_fp_end", F.desc("_fp_key"), F.xxhash64(text))
    out = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry))
    return out.filter(F.col("_fp_end") == 0).drop("_fp_key", "_fp_block", "_fp_to", "_fp_place", "_fp_at", "_fp_end")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    d = with_next(d, "doc_id", "text", ["text", "sketch"], compute=lambda rows: with_sketch(rows, "text", "sketch"))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    d = with_sketch(d, "edited", "edited_sketch")
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
    )


def merge_all(sketches: list[Column], k: int = K) -> Column:
    return reduce(lambda a, b: merge(a, b, k), sketches)
