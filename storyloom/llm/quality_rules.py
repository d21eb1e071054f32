"""Quality rules: a table of thresholds compiled into one Spark projection.

``measures`` adds word, symbol, letter, function-word, line, list and repetition measures to every
row; ``apply_rules`` turns a table of ``Rule`` rows into one boolean column and
the list of rules a row breaks. There is no user function and no shuffle: each row
is judged by itself, on its whole text.

Defined cases: a null text has no words and counts as the empty one; empty
texts fail ``min_words``; a null in any other column passes through; repeated rows
are judged alike, one result each; an empty table gives an empty result. Measures
live in one struct column, ``_quality``, so that extra input columns with any other
name pass through untouched; an input column of that name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, documents, text_of, word_array

#: Words up to this length count as function words in any language, as do the stop words below.
SHORT = 3
#: Common words of four languages.
STOP_WORDS = {
    "en": "the of and to in that for is was with on as by at from this be are not it he she they we you have had but which or an all",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec il elle ce se ou ne par plus son sa ses",
    "de": "der die das und ist in den von zu mit nicht ein eine auf für im dem des sich auch als an es er sie wie bei aus oder",
    "es": "el la los las de del un una y es en que por para con no se su al lo como más o pero sus le ha me si",
}
SYMBOLS = "#*$%&|<>"
#: What makes a line one of a list, and what it trails off with.
BULLETS, TRAILS = "-*•", ("...", "…")
#: All of ASCII but letters.
_NO_LETTERS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalpha())


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; a missing bound does not bind. Rules bind from ``from_words`` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The base rules stand first: they alone make ``base_failed``.
BASE_RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_percent", high=50),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "mean_word", low=2, high=12),
    Rule("symbols", "symbols_per_word", high=0.35),
    Rule("function_words", "stop_ratio", low=0.01, from_words=80),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("letters", "letter_ratio", low=0.6),
    Rule("listed_lines", "bullet_ratio", high=0.9),
    Rule("trailing_lines", "trail_ratio", high=0.3),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``_quality``. Three projections feed one another, as each array is used more than once."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    out = df.withColumn("_quality", F.struct(word_array(t).alias("w"), lines.alias("l")))
    w = F.col("_quality.w")
    # a window of three words stands as (hash, first position); sorted, equal windows are neighbours
    window = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn(
        "_quality",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_quality.l").cast("long").alias("n_lines"),
            (F.size("_quality.l") - F.size(F.array_distinct("_quality.l"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: (F.length(x) <= SHORT) & (F.translate(x, _NO_LETTERS, "") == x) | F.lower(x).isin(stop))).cast("long").alias("n_stop"),
            F.length(F.translate(t, _NO_LETTERS, "")).cast("long").alias("n_letters"),
            F.size(F.filter("_quality.l", lambda x: F.left(F.btrim(x, F.lit(SPACES)), F.lit(1)).isin(*BULLETS))).cast("long").alias("n_bullets"),
            F.size(F.filter("_quality.l", lambda x: F.btrim(x, F.lit(SPACES)).endswith(TRAILS[0]) | F.btrim(x, F.lit(SPACES)).endswith(TRAILS[1]))).cast("long").alias("n_trails"),
            F.sort_array(window).alias("s"),
        ),
    )
    s = F.col("_quality.s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
    out = out.withColumn("_quality", F.col("_quality").withField("s", F.sort_array(F.transform(twice, lambda x: x["i"]))))
    p = F.col("_quality.s")
    # a window covers three words, or as many as there are before the next one starts
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    q = F.col("_quality")
    out = out.withColumn("_quality", q.withField("n_repeat_words", covered.cast("long")).dropFields("s"))
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.withColumn(
        "_quality",
        q.withField("mean_word", per(q["word_chars"], q["n_words"]))
        .withField("symbols_per_word", per(q["n_symbols"], q["n_words"]))
        .withField("stop_ratio", per(q["n_stop"], q["n_words"]))
        .withField("dup_line_ratio", per(q["n_dup_lines"], q["n_lines"]))
        .withField("letter_ratio", per(q["n_letters"], q["word_chars"]))
        .withField("bullet_ratio", per(q["n_bullets"], q["n_lines"]))
        .withField("trail_ratio", per(q["n_trails"], q["n_lines"]))
        .withField("repeat_percent", per(100 * q["n_repeat_words"], q["n_words"])),
    )


def broken(rule: Rule) -> Column:
    m, tests = F.col(f"_quality.{rule.measure}"), []
    if rule.low is not None:
        tests.append(m < F.lit(rule.low))
    if rule.high is not None:
        tests.append(m > F.lit(rule.high))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out & (F.col("_quality.n_words") >= F.lit(rule.from_words)) if rule.from_words else out


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows, with ``_quality`` and its field ``broken``: the names of the rules that the row breaks, in table order."""
    names = F.array_compact(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)))
    # what is not deterministic keeps the optimiser from writing all measures out again within a filter on the verdict
    names = F.when(F.monotonically_increasing_id() >= 0, names)
    return measures(df, text).withColumn("_quality", F.col("_quality").withField("broken", names))


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, with the columns that came."""
    return apply_rules(df, rules, text).filter(F.size("_quality.broken") == 0).drop("_quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    q = F.col("_quality")
    base = [r.name for r in BASE_RULES]
    return d.select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.arrays_overlap(q["broken"], F.array(*map(F.lit, base))).alias("base_failed"), (F.size(q["broken"]) == 0).alias("kept"), q["broken"].alias("broken"))


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _sql_rule(r: Rule) -> str:
    tests = [f"{r.measure} < {r.low}" * (r.low is not None), f"{r.measure} > {r.high}" * (r.high is not None)]
    test = " or ".join(t for t in tests if t)
    return f"(({test}) and n_words >= {r.from_words})" if r.from_words else f"({test})"


_SQL_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACES)
_SQL_NO_LETTERS = " || ".join(f"chr({ord(c)})" for c in _NO_LETTERS)

ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g from w, unnest(range(1, len(w) - 1)) u(i)),
c as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
r as (select doc_id, count(distinct i + k) as n from c, range(3) u(k) group by 1),
m as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
  len(list_filter(w, lambda x: length(x) <= {SHORT} and translate(x, {_SQL_NO_LETTERS}, '') = x or lower(x) in ({_sql_list(sorted({x for v in STOP_WORDS.values() for x in v.split()}))})))::bigint as n_stop,
  length(translate(t, {_SQL_NO_LETTERS}, ''))::bigint as n_letters,
  len(list_filter(l, lambda x: left(trim(x, {_SQL_SPACES}), 1) in ({_sql_list(list(BULLETS))})))::bigint as n_bullets,
  len(list_filter(l, lambda x: {" or ".join(f"ends_with(trim(x, {_SQL_SPACES}), '{x}')" for x in TRAILS)}))::bigint as n_trails
  from w left join r using (doc_id)),
q as (select *, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word, coalesce(n_symbols / nullif(n_words, 0), 0) as symbols_per_word,
  coalesce(n_stop / nullif(n_words, 0), 0) as stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_ratio,
  coalesce(n_letters / nullif(word_chars, 0), 0) as letter_ratio, coalesce(n_bullets / nullif(n_lines, 0), 0) as bullet_ratio, coalesce(n_trails / nullif(n_lines, 0), 0) as trail_ratio,
  coalesce(100 * n_repeat_words / nullif(n_words, 0), 0) as repeat_percent from m),
b as (select *, list_filter([{", ".join(f"case when {_sql_rule(r)} then '{r.name}' end" for r in RULES)}], lambda x: x is not null) as broken from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" or ".join(f"list_contains(broken, '{r.name}')" for r in BASE_RULES)} as base_failed, len(broken) = 0 as kept, broken from b
"""
