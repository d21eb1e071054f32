"""Surrogates for personal data, in Spark's own functions only.

Found are e-mail addresses, phone numbers (international, and as the USA, France, Spain, Germany and the United
Kingdom write them), payment cards (with a right check digit), IBANs (likewise), social security numbers, IP addresses
of version 4 and 6, and names after a form of address, with what else in the same document repeats
a part of them: "Mrs. Anna Smith .. Anna .. Smith .. SMITH". A name that no form of address introduces anywhere in its document is not found; after one that tells no gender
("Dr"), a given name has the gender that another mention in the document tells, or a neutral replacement.

Each distinct entity gets a replacement drawn from a keyed hash, of its own kind: an address keeps its layout and top
domain, a phone number its layout and country code, a card its network and a right check digit, an IBAN its country, layout
and right check digits. A name is replaced part by part, so that who shares a family name still does: a given name
keeps the gender that the form of address tells, and each part its script. The same entity, however it is spelt, gets the same replacement everywhere.

Collisions are checked over the whole corpus: while two entities of a kind share a replacement, or a
replacement is itself an entity of the corpus, all but the least of them draw anew, and from a larger space each time
(one more syllable, letter or digit); so distinct entities stay distinct and the rounds end.

Defined cases: a null text stays null and counts no entities, an empty one stays
empty; a null ``doc_id`` stays null; repeated rows give one result each; an empty
table gives an empty result. Extra columns pass through; only names that begin with
``_pii_`` are taken, and ``n_entities`` and ``kinds``, if they came, are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import Scratch, documents, text_of

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NOT_AFTER, _NOT_BEFORE = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = rf"{_NOT_AFTER}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?){_NOT_BEFORE}"
CARD = rf"{_NOT_AFTER}(?:[0-9]{{4}}(?<sep>[ -])[0-9]{{4}}\k<sep>[0-9]{{4}}\k<sep>[0-9]{{4}}|[0-9]{{4}}(?<gap>[ -])[0-9]{{6}}\k<gap>[0-9]{{5}}|[0-9]{{13,19}}){_NOT_BEFORE}"
_H16 = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![A-Za-z0-9:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_H16}:){{7}}{_H16}|{_H16}(?::{_H16}){{0,5}}::(?:{_H16}(?::{_H16}){{0,5}})?|::{_H16}(?::{_H16}){{0,6}})(?![A-Za-z0-9:]|\.[0-9])"
IP = rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])"
SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])"
_ABROAD = r"(?<![A-Za-z0-9+])(?:\+[1-9][0-9]{0,2}[ .-]?|00[1-9][0-9]{0,2}[ .-])(?:\(0?[0-9]{0,4}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{2,5}){1,5}"
_NORTH_AMERICA = r"(?:(?<![A-Za-z0-9])\([0-9]{3}\) ?|(?<![A-Za-z0-9.-])[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}"
_FRANCE = r"(?<![A-Za-z0-9.-])0[1-9](?:(?<by>[ .-])[0-9]{2})(?:\k<by>[0-9]{2}){3}"
_SPAIN = r"(?<![A-Za-z0-9.-])[6-9][0-9]{2}(?: [0-9]{3}){2}|(?<![A-Za-z0-9.-])[6-9][0-9]{2}(?: [0-9]{2}){3}"
_TRUNK = r"(?<![A-Za-z0-9.-])(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,8}(?:[ -][0-9]{3,6})?"
PHONE = rf"(?:{_ABROAD}|{_NORTH_AMERICA}|{_FRANCE}|{_SPAIN}|{_TRUNK}){_NOT_BEFORE}"
#: Digits of a phone number.
LEAST_DIGITS, MOST_DIGITS = 8, 15
#: Forms of address by gender, and small words within names.
FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mademoiselle", "Frau", "Señora", "Señorita", "Sra", "Doña", "Госпожа")
MALE = ("Mr", "Mister", "Monsieur", "Herr", "Señor", "Sr", "Don", "Господин")
EITHER = ("Dr", "Doctor", "Prof", "Professor")
PARTICLES = ("von", "van", "der", "den", "de", "del", "la", "di", "da", "du", "le", "y")
_PART = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
_FORMS = rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({x[0] for x in FEMALE + MALE + EITHER}))}])(?:{'|'.join(sorted(FEMALE + MALE + EITHER, key=len, reverse=True))})\.?+ "
_NEXT = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_PART})"
NAME = rf"(?:{_FORMS})+(?:\p{{Lu}}\. ){{0,2}}(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_PART}(?: \p{{Lu}}\.(?= ))?{_NEXT}{{0,2}}(?![\p{{L}}\p{{M}}\p{{N}}])"
ANY = "|".join((EMAIL, IBAN, CARD, IP6, IP, SSN, PHONE, NAME))
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "name")

#: Syllables of replacement names, by script.
_LATIN = ("ba", "de", "lo", "mi", "na", "ri", "sa", "te", "vo", "ka", "le", "mo", "ni", "ro", "su", "ta", "ve", "el", "ar", "on", "in", "ol")
_CYRILLIC = ("ба", "де", "ло", "ми", "на", "ри", "са", "те", "во", "ка", "ле", "мо", "ни", "ро", "су", "та", "ве", "ел", "ар", "он", "ин", "ол")


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column, last: bool) -> Column:
    """Sum of the digits, every other doubled; the rightmost is the check digit itself if ``last``."""
    odd = 1 if last else 0
    one = lambda c, i: F.when(i % 2 == odd, F.when(c >= 5, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    return F.aggregate(F.transform(_chars(F.reverse(digits)), lambda c, i: one(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN's digits, its first four characters last and letters as two digits each."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.left(iban, F.lit(4)))
    return F.aggregate(F.transform(_chars(turned), number), F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def kind_of(e: Column) -> Column:
    """Null for what only looks like an entity: a number with a wrong check digit or length."""
    digits, code = _digits(e), F.replace(e, F.lit(" "), F.lit(""))
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), F.when(F.length(code).between(15, 34) & (_mod97(code) == 1), "iban"))
        .when(e.rlike(rf"^(?:{IP}|{IP6})$"), "ip")
        .when(e.rlike(rf"^(?:{CARD})$"), F.when(_luhn(digits, True) % 10 == 0, "card"))
        .when(e.rlike(rf"^{SSN}$"), "ssn")
        .when(e.rlike(r"^[+(0-9]"), F.when(F.length(digits).between(LEAST_DIGITS, MOST_DIGITS), "phone"))
        .otherwise("name")
    )


def canonical(kind: Column, e: Column) -> Column:
    """What all spellings of one entity share; for names see ``name_parts``."""
    phone = F.regexp_replace(F.regexp_replace(e, r"\(0\)", ""), "^00", "+")
    return F.when(kind == "phone", F.regexp_replace(phone, "[^0-9+]", "")).when(kind.isin("card", "ssn"), _digits(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(F.lower(e))


def _words(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w.rlike(rf"^{_PART}$") & ~_is_form(w))


def _is_form(word: Column) -> Column:
    return F.rtrim(word, F.lit(".")).isin(*FEMALE, *MALE, *EITHER)


def _gender(name: Column) -> Column:
    """As the first form of address that tells it says."""
    forms = F.transform(F.filter(F.split(name, " "), _is_form), lambda w: F.rtrim(w, F.lit(".")))
    return F.when(F.exists(forms, lambda w: w.isin(*FEMALE)), "f").when(F.exists(forms, lambda w: w.isin(*MALE)), "m").otherwise("n")


def name_parts(name: Column) -> Column:
    """(kind, word) of the parts of a name after a form of address: the last is the family's, the others are given names of its gender."""
    words = _words(name)
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given "), _gender(name))).alias("kind"), w.alias("word")))


def _like(part: Column, seed: Column) -> Column:
    """Letters for letters and digits for digits."""
    return F.array_join(
        F.transform(_chars(part), lambda c, i: F.when(c.rlike("[a-z]"), F.chr(F.lit(97) + _draw(seed, i, 26))).when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).otherwise(c)), ""
    )


def _number(digits: Column, keep: Column, seed: Column) -> Column:
    return F.array_join(F.transform(_chars(digits), lambda c, i: F.when((i < keep) | (c == "+"), c).otherwise(_draw(seed, i, 10).cast("string"))), "")


def _more(seed: Column, attempt: Column, most: int, one) -> Column:
    """What a draw adds: one(k) for each attempt before, ``most`` of them at most."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(most))), lambda k: F.when(k > 0, one(k)).otherwise("")), "")


def surrogate(kind: Column, canon: Column, seed: Column, attempt: Column, key: str) -> Column:
    """The canonical replacement drawn from a seed, from a space that grows with the attempt; the site of an address has a seed of its own."""
    letter = lambda k: F.chr(F.lit(97) + _draw(seed, 100 + k, 26))
    digit = lambda k: _draw(seed, 100 + k, 10).cast("string")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    site = F.sha2(F.concat(F.lit(f"{key}|site|"), domain), 256)
    email = F.concat(_like(local, seed), _more(seed, attempt, 64, letter), F.lit("@"), _like(host, site), top)
    body = F.concat(_number(F.substring(canon, F.lit(1), F.length(canon) - 1), F.lit(1), seed), _more(seed, attempt - 3, 64, digit))
    card = F.concat(body, F.pmod(-_luhn(body, False), F.lit(10)).cast("string"))
    abroad = canon.startswith("+")
    phone = F.concat(_number(canon, F.when(abroad, F.least(F.lit(4), F.length(canon) - 7)).otherwise(F.greatest(F.lit(1), F.length(canon) - 10)), seed), _more(seed, attempt - 3, 64, digit))
    ssn = F.concat((100 + _draw(seed, 0, 500)).cast("string"), (10 + _draw(seed, 1, 90)).cast("string"), (1000 + _draw(seed, 2, 9000)).cast("string"), _more(seed, attempt - 3, 64, digit))
    basic = F.concat(_like(F.lower(F.substring(canon, F.lit(5), F.length(canon))), seed), _more(seed, attempt - 3, 64, digit))
    unchecked = F.concat(F.left(canon, F.lit(2)), F.lit("00"), F.upper(basic))
    iban = F.concat(F.left(canon, F.lit(2)), F.lpad((98 - _mod97(unchecked)).cast("string"), 2, "0"), F.upper(basic))
    ip4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _draw(seed, i, 254)).cast("string")), ".")
    ip6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(4096 + _draw(seed, i, 61440)))), ":")
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    script = F.when(cyrillic, F.array(*map(F.lit, _CYRILLIC))).otherwise(F.array(*map(F.lit, _LATIN)))
    ends = {"given f": ("a", "а"), "given m": ("n", "н"), "given n": ("e", "е"), "family": ("k", "к")}
    end = reduce(lambda c, x: c.when(kind == x, F.when(cyrillic, ends[x][1]).otherwise(ends[x][0])), ends, F.when(F.lit(False), ""))
    syllable = lambda j: F.element_at(script, (1 + _draw(seed, j, len(_LATIN))).cast("int"))
    name = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), syllable), ""), end))
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "ip", F.when(canon.contains(":"), ip6).otherwise(ip4)).otherwise(name)


def _poured(kind: Column, e: Column, s: Column) -> Column:
    """The canonical replacement in the layout of this spelling; what it has more than that comes at the end."""
    trunk, zeros = F.regexp_extract(e, r"^.*?\(0\)", 0), e.startswith("00")
    head = F.when((kind == "phone") & (trunk != ""), F.concat(F.replace(trunk, F.lit("(0)"), F.lit("\x01")), F.substring(e, F.length(trunk) + 1, F.length(e)))).when((kind == "phone") & zeros, F.concat(F.lit("\x02"), F.substring(e, F.lit(3), F.length(e)))).otherwise(e)
    code = F.when(kind == "iban", s).otherwise(_digits(s))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    step = lambda a, c: F.when(c.rlike("[0-9]") | ((kind == "iban") & c.rlike("[A-Z]")), F.struct(F.concat(a["out"], F.substring(code, a["i"] + 1, F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    number = F.aggregate(_chars(head), start, step, lambda a: F.concat(a["out"], F.substring(code, a["i"] + 1, F.length(code))))
    number = F.replace(F.replace(number, F.lit("\x01"), F.lit("(0)")), F.lit("\x02"), F.lit("00"))
    return F.when(kind.isin("card", "phone", "iban", "ssn"), number).when((kind == "email") & (F.upper(e) == e), F.upper(s)).otherwise(s)


def mapping(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities; no two of a kind share a surrogate, none is an entity."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 256)
    drawn = surrogate(F.col("kind"), F.col("canon"), seed, F.col("attempt"), key).alias("surrogate")
    group = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), "name").otherwise(F.col("kind")).alias("group")
    rows = scratch.written(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).select("*", group).select("*", drawn), "surrogates")
    while True:
        real = rows.select("group", F.col("canon").alias("low")).distinct().withColumn("real", F.lit(True))
        least = rows.groupBy("kind", "surrogate").agg(F.min("canon").alias("least"))
        x = rows.join(least, ["kind", "surrogate"]).withColumn("low", F.when(F.col("kind") == "iban", F.col("surrogate")).otherwise(F.lower("surrogate"))).join(real, ["group", "low"], "left")
        clash = (F.col("canon") != F.col("least")) | F.col("real").isNotNull()
        x = scratch.written(x.select("kind", "canon", "group", "attempt", F.col("surrogate").alias("held"), clash.alias("clash")), "clashes")
        if x.filter("clash").isEmpty():
            return rows.select("kind", "canon", "surrogate")
        again = x.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        rows = scratch.written(again.select("kind", "canon", "attempt", "group", F.when(F.col("clash"), drawn).otherwise(F.col("held")).alias("surrogate")), "surrogates")


def _known(parts: Column) -> Column:
    """Parts of a document's names, a given name of no known gender as one of a gender that the document tells."""
    def told(p: Column) -> Column:
        same = F.filter(parts, lambda q: (F.lower(q["word"]) == F.lower(p["word"])) & q["kind"].isin("given f", "given m"))
        return F.when((p["kind"] == "given n") & (F.size(same) > 0), F.get(same, F.lit(0))["kind"]).otherwise(p["kind"])

    return F.array_distinct(F.transform(parts, lambda p: F.struct(told(p).alias("kind"), p["word"].alias("word"))))


def _renamed(name: Column, here) -> Column:
    """A mention of a name, with or without a form of address, part by part; ``here`` gives a part's surrogate or null."""
    words, parts, titled = F.split(name, " "), _words(name), F.exists(F.split(name, " "), _is_form)
    given = ("given f", "given m", "given n")

    def one(w: Column) -> Column:
        low = F.lower(w)
        own = F.concat(F.lit("given "), _gender(name))
        first = F.coalesce(here(own, low), *(here(F.lit(k), low) for k in given), here(F.lit("family"), low))
        family = F.coalesce(here(F.lit("family"), low), *(here(F.lit(k), low) for k in given))
        s = F.when(titled & (w != F.get(parts, F.size(parts) - 1)), first).otherwise(family)
        s = F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(s)).otherwise(s)
        initial = w.rlike(r"^[A-Z]\.$")
        return F.when(_is_form(w), w).when(initial, F.concat(F.chr(65 + (F.ascii(w) - 65 + 7) % 26), F.lit("."))).otherwise(F.coalesce(s, w))

    return F.array_join(F.transform(words, one), " ")


def pseudonymise(df: DataFrame, key: str = "storyloom") -> DataFrame:
    """The rows and columns that came, with surrogates in ``text``, and ``n_entities`` and ``kinds`` (the entities' kinds, in order)."""
    scratch = Scratch(df.sparkSession)
    cols = [c for c in df.columns if c not in ("n_entities", "kinds")]
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may = F.contains(text, F.lit("@")) | text.rlike("[0-9]") | text.rlike(_FORMS)  # what every entity has, and is told fast
    clean = df.filter(~may | ~text.rlike(ANY)).select(*cols, F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"))
    found = df.filter(may & text.rlike(ANY)).select(*cols, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("_pii_e"))
    found = scratch.written(found.withColumn("_pii_h", F.xxhash64("text")), "found")
    said = found.select("doc_id", "_pii_h", F.transform("_pii_e", lambda e: F.struct(kind_of(e).alias("kind"), e.alias("e"))).alias("m"))
    plain = F.transform(F.filter("m", lambda m: m["kind"].isNotNull() & (m["kind"] != "name")), lambda m: F.struct(m["kind"].alias("kind"), canonical(m["kind"], m["e"]).alias("word")))
    parts = _known(F.flatten(F.transform(F.filter("m", lambda m: m["kind"] == "name"), lambda m: name_parts(m["e"]))))
    said = scratch.written(said.select("doc_id", "_pii_h", plain.alias("plain"), parts.alias("parts")).dropDuplicates(["doc_id", "_pii_h"]), "said")
    lower = lambda p: F.struct(p["kind"].alias("kind"), F.lower(p["word"]).alias("word"))
    each = said.select("doc_id", "_pii_h", F.explode(F.array_distinct(F.concat("plain", F.transform("parts", lower)))).alias("x")).select("doc_id", "_pii_h", "x.kind", F.col("x.word").alias("canon"))
    new = each.join(mapping(each, key, scratch), ["kind", "canon"])
    new = new.groupBy("doc_id", "_pii_h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "surrogate"))).alias("_pii_new"))
    of = lambda x: x.withColumnRenamed("doc_id", "_pii_doc").withColumnRenamed("_pii_h", "_pii_of")
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: F.array(p["word"], F.upper(p["word"]))))), lambda a, b: F.length(b) - F.length(a))
    one = F.concat(F.lit("(?:"), F.array_join(words, "|"), F.lit(")"))
    bare = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}\\p{{N}}])"), one, F.lit("(?: "), one, F.lit(")*(?![\\p{L}\\p{M}\\p{N}])"))
    how = said.select("doc_id", "_pii_h", F.when(F.size("parts") > 0, bare).otherwise(F.lit(ANY)).alias("_pii_find"))
    how = how.join(of(new), how["doc_id"].eqNullSafe(F.col("_pii_doc")) & (how["_pii_h"] == F.col("_pii_of")), "left").select("doc_id", "_pii_h", "_pii_find", "_pii_new")
    how = scratch.written(how, "how")
    out = found.drop("_pii_e").join(of(how), found["doc_id"].eqNullSafe(F.col("_pii_doc")) & (found["_pii_h"] == F.col("_pii_of")), "left")
    here = lambda kind, canon: F.try_element_at(F.coalesce("_pii_new", F.create_map().cast("map<string,string>")), F.concat_ws(":", kind, canon))

    def replaced(e: Column) -> Column:
        kind = kind_of(e)
        s = here(kind, canonical(kind, e))
        return F.struct(F.when(kind == "name", _renamed(e, here)).otherwise(F.coalesce(_poured(kind, e, s), e)).alias("new"), kind.alias("kind"))

    # the text between the entities, and what now stands for each of them
    out = out.withColumn("_pii_x", F.transform(F.regexp_extract_all("text", F.col("_pii_find"), F.lit(0)), replaced))
    texts = F.zip_with(F.split("text", F.col("_pii_find")), F.concat(F.transform("_pii_x", lambda x: x["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    out = out.withColumn("_pii_text", F.array_join(texts, "")).withColumn("_pii_kinds", F.array_compact(F.transform("_pii_x", lambda x: x["kind"])))
    return clean.unionByName(out.select(*(F.col("_pii_text" if c == "text" else c).alias(c) for c in cols), F.size("_pii_kinds").cast("long").alias("n_entities"), F.col("_pii_kinds").alias("kinds")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", "n_entities", *map(count, KINDS), text_of().alias("text"))
