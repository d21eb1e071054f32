"""Text scalars as column expressions: cleaning, naming, templates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Canonical composition: Spark has no function for it."""
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


#: Unicode's white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` alone would take spaces only."""
    return F.btrim(c, F.lit(WHITE))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)-\s*\n\s*", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, however often the body or a lambda in it uses it."""
    return F.transform(F.array(value), body)[0]


def drop_running_lines(c: Column, most: int = 80, repeats: int = 5) -> Column:
    """Without page numbers, page labels, and short lines that come ``repeats`` times or more.

    Repeats are found by sorting a page's short lines, so that the work stays near linear in them.
    """
    lines = F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("s")))

    def often(all_: Column) -> Column:
        short = F.sort_array(F.filter(F.transform(all_, lambda x: x["s"]), lambda s: F.length(s).between(1, most - 1)))
        # sorted, a line that comes n times equals the one n - 1 places on
        return let(short, lambda ordered: F.array_distinct(F.filter(ordered, lambda x, i: F.get(ordered, i + (repeats - 1)) == x)))

    def kept(s: Column, gone: Column) -> Column:
        number = (F.length(s) < 10) & s.rlike(r"(?U)^[\d\s\-–—]+$")
        label = s.rlike(r"(?iU)^(page|p\.)\s*\d+")
        return (s == "") | ~(F.array_contains(gone, s) | number | label)

    def without(all_: Column, gone: Column) -> Column:
        return F.array_join(F.transform(F.filter(all_, lambda x: kept(x["s"], gone)), lambda x: F.when(x["s"] == "", "").otherwise(x["line"])), "\n")

    return let(lines, lambda all_: let(often(all_), lambda gone: without(all_, gone)))


def paragraphs(c: Column) -> Column:
    """Paragraphs parted by one empty line, each on one line."""
    parts = F.split(c, "\n\n+")
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != ""), "\n\n")


def clean(df: DataFrame, text: str = "text", out: str = "cleaned") -> DataFrame:
    """All cleaning steps in order; each is a projection of its own."""
    df = df.withColumn(out, nfc(F.col(text)))
    for step in (dehyphenate, drop_running_lines, collapse_spaces, paragraphs, strip):
        df = df.withColumn(out, step(F.col(out)))
    return df


def title_and_author(stem: Column) -> Column:
    """struct(title, author) of a file's name: "a - b" with at most three words before the dash names the author first; "x by y" in lower case; else all is the title."""
    dash = F.instr(stem, " - ")
    left, right = F.left(stem, dash - 1), F.substring(stem, dash + 3, F.length(stem))
    low = F.lower(stem)
    by = F.instr(low, " by ")
    words = F.size(F.filter(F.split(left, r"(?U)\s+"), lambda w: w != ""))
    pair = lambda t, a: F.struct(t.alias("title"), a.alias("author"))
    return F.when(dash > 0, F.when(words <= 3, pair(right, left)).otherwise(pair(left, right))).when(by > 0, pair(strip(F.left(low, by - 1)), strip(F.substring(low, by + 4, F.length(low))))).otherwise(pair(stem, F.lit("Unknown")))


def slug(c: Column, most: int = 100) -> Column:
    """Lower-case ASCII words joined by dashes."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def entity(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def passage_id(book: Column, chunk: Column) -> Column:
    return F.concat_ws("_", book, chunk.cast("string"))


def mentions(text: Column, name: Column) -> Column:
    return F.contains(F.lower(text), F.lower(name))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; doubled braces stand for single ones."""
    out = F.replace(template, F.lit("{{"), F.lit("\x01"))
    out = F.reverse(F.replace(F.reverse(out), F.lit("}}"), F.lit("\x02")))  # of three braces the last two are one
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.translate(out, "\x01\x02", "{}")


def spoken(relation: Column) -> Column:
    return F.lower(F.replace(relation, F.lit("_"), F.lit(" ")))


def passage_header(pid: Column) -> Column:
    return F.concat(F.lit("\n--- Passage "), pid, F.lit(" ---\n"))
