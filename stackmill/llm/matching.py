"""Matching entities across sources without a shared identifier (problem 2).

Records become a key (content words of the title in order, misspelt words replaced by the frequent
word they are within reach of, look-alike letters and accents folded), a mark of what kind of part
or reply they are, a subtitle, name words and a year. Pairs of records of two sources that share a
key are scored by a log-odds sum; loopy belief propagation over the pairs, with one factor per
entity and other source that lets at most one pair be true, turns the scores into marginals.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.llm.lookalike import ARMENIAN_LATIN, ARMENIAN_LOOKALIKES, CYRILLIC_LATIN, CYRILLIC_LOOKALIKES, GREEK_LATIN, GREEK_LOOKALIKES
from stackmill.llm.names import ACCENTS, merged, segment_links
from stackmill.plans.skew import attach
from stackmill.session import cut, discard

# Words without weight in a title, and stand-ins that are no title.
LIGHT_WORDS = ["a", "an", "the", "of", "and"]
NO_TITLE = ["", "untitled", "no title", "title not available", "unknown", "null", "none", "n a", "na", "tbd", "not available"]
ACRONYM = r"(?<!\p{L})(?!AND\b)\p{Lu}{3,7}(?!\p{L})"
#: Name words that make up this share of all are common: given names, mostly. So there are at most 1/COMMON_SHARE.
#: Below COMMON_LEAST occurrences the share says nothing.
COMMON_SHARE, COMMON_LEAST, COMMON_WEIGHT = 0.003, 50, 0.3
#: A word is a misspelling of another within reach when that one is this many times as frequent. Frequency is the evidence:
#: in a small table a word of few occurrences is not told from a misspelling, and titles with it must agree as they are.
FREQUENCY_RATIO = 20
#: Titles of more records than this don't give all their pairs, only those that names and years can bring above LEAST_SCORE.
GENERIC_TITLE = 64
#: Log-odds of the evidence. Two years apart is both sides being off by one.
#: The title weighs less the more works have it, but never so little that equal names and year don't carry a pair.
LEAST_TITLE = -3.0
TITLE, AUTHORS_AGREE, AUTHORS_PART, AUTHORS_DIFFER = 3.0, 5.0, -1.0, -6.0
YEAR_SAME, YEAR_NEXT, YEAR_BOTH, YEAR_DIFFERS, SUBTITLE_MISSING, SUBTITLE_DIFFERS = 2.0, 1.0, -0.5, -6.0, -0.5, -14.0
#: Letters from which on a name word may be slipped, and from which on by three edits.
SLIP_LEAST, LONG_NAME = 6, 10
SIDE = ("id", "src", "ent", "sub", "names", "rare", "acronym", "year", "mended")
#: What a pair has of each side: the names that another source has too under the key beside the rest.
PAIRED = (*SIDE, "known")
LEAST_SCORE, DAMPING, TOLERANCE, MOST_ROUNDS = -4.0, 0.5, 1e-3, 30


# Code points of the kinds of space.
SPACES = [0x09, 0x0A, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def _twins() -> tuple[str, str]:
    """Characters folded one for one: full-width forms, kinds of space, letters of other scripts."""
    table = {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)} | dict.fromkeys(map(chr, SPACES), " ")
    table |= {a.lower(): b.lower() for a, b in zip(CYRILLIC_LOOKALIKES + GREEK_LOOKALIKES + ARMENIAN_LOOKALIKES, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN, strict=True)}
    table |= {"\u00b5": "m"} | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-")
    marked, base = ACCENTS
    table |= dict(zip(marked, base, strict=True))
    return "".join(table), "".join(table.values())


_FROM, _TO = _twins()


def plain(text: Column) -> Column:
    """Lower-case text with look-alikes, widths, accents and invisible characters folded; JVM only.

    Text of one byte per character needs none of the folding.
    """
    low = F.replace(F.replace(F.lower(text), F.lit("{")), F.lit("}"))
    flat = F.translate(F.regexp_replace(low, r"[\p{Cf}\p{M}]", ""), _FROM, _TO)
    for twin, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "ss"), ("{", ""), ("}", "")):
        flat = F.replace(flat, F.lit(twin), F.lit(letters))
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(flat)


_PREFIX = r"^\s*([a-z]{3,12})\s+(?:to|on|of)\s*:\s*"
_NUMBERED = r"[:,(\-]\s*([a-z])[a-z]{1,10}\.?\s+([ivx]{1,4}|[a-h]|[0-9]{1,3})\)?$"
_FOLLOW_UP = r"[:,(\-]\s*(?:an?\s+)?f[a-z]{2,7}[- ]?[a-z]{0,2}up\)?$"
_PARENTHESIS = r"\(([^()]*)\)$"


_MAY_BE_MARKED = r"[):]|up$|\s(?:[ivx]{1,4}|[a-h]|[0-9]{1,3})$"


def parsed_titles(df: DataFrame) -> DataFrame:
    """Adds marker, words (content words of the key part, as text) and sub to rows with a ``title``."""
    df = df.withColumn("_t", F.regexp_replace(F.trim(plain(F.col("title"))), r"[\s.]+$", ""))
    begins = F.col("_t").rlike(_PREFIX)
    df = df.withColumn("_pre", F.when(begins, F.substring(F.regexp_extract("_t", _PREFIX, 1), 1, 3)).otherwise("")).withColumn("_t", F.when(begins, F.regexp_replace("_t", _PREFIX, "")).otherwise(F.col("_t")))
    kind = F.when(~F.col("_t").rlike(_MAY_BE_MARKED), 0).when(F.col("_t").rlike(_NUMBERED), 1).when(F.col("_t").rlike(_FOLLOW_UP), 2).when(F.col("_t").rlike(_PARENTHESIS), 3).otherwise(0)
    df = df.withColumn("_k", kind)
    numbered = F.concat_ws(" ", F.regexp_extract("_t", _NUMBERED, 1), F.regexp_extract("_t", _NUMBERED, 2))
    inner = F.regexp_replace(F.regexp_extract("_t", _PARENTHESIS, 1), r"([a-z0-9])[a-z0-9]*\s*", "$1")
    df = df.withColumn("marker", F.concat_ws("|", "_pre", F.when(F.col("_k") == 1, numbered).when(F.col("_k") == 2, "follow").when(F.col("_k") == 3, inner).otherwise("")))
    rest = F.when(F.col("_k") == 1, F.regexp_replace("_t", _NUMBERED, "")).when(F.col("_k") == 2, F.regexp_replace("_t", _FOLLOW_UP, "")).when(F.col("_k") == 3, F.regexp_replace("_t", _PARENTHESIS, "")).otherwise(F.col("_t"))
    light = f"(?:\\b(?:{'|'.join(LIGHT_WORDS)})\\b|[^\\p{{L}}\\p{{N}}])+"
    tidy = lambda p: F.trim(F.regexp_replace(p, light, " "))
    df = df.withColumn("_p", F.filter(F.transform(F.split(rest, r"\s*:\s+|\s+-\s+|:$"), tidy), lambda p: p != ""))
    # A first part of one or two words ("X revisited") is no title by itself.
    short = (F.size("_p") > 1) & ~F.element_at("_p", 1).rlike(r" \S+ ")
    key = F.when(short, F.concat_ws(" ", F.slice("_p", 1, 2))).otherwise(F.coalesce(F.try_element_at("_p", F.lit(1)), F.lit("")))
    rest_of = lambda start: F.slice("_p", start, F.greatest(F.size("_p"), F.lit(1)))
    sub = F.array_join(F.when(short, rest_of(3)).otherwise(rest_of(2)), " ")
    return df.withColumn("words", F.when(key.isin(NO_TITLE), "").otherwise(key)).withColumn("sub", sub).drop("_t", "_pre", "_p", "_k")


def source(df: DataFrame, number: int, id_column: str, authors_column: str, entity_column: str | None = None, title_column: str = "title", year_column: str = "year") -> DataFrame:
    """One source as (id, src, ent, title, authors, year). ``ent`` groups rows known to be one entity."""
    year = F.regexp_extract(F.col(f"`{year_column}`").cast("string"), r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])", 1)
    ent = F.xxhash64(F.lit(number), F.col(f"`{id_column}`").cast("bigint"))
    if entity_column is not None:
        ent = F.when(F.col(f"`{entity_column}`").isNotNull(), F.xxhash64(F.lit(number), F.lit("entity"), F.col(f"`{entity_column}`"))).otherwise(ent)
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.lit(number).alias("src"), ent.alias("ent"), F.col(f"`{title_column}`").cast("string").alias("title"), F.col(f"`{authors_column}`").cast("string").alias("authors"), F.nullif(year, F.lit("")).cast("int").alias("year"))


def prepared(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources with their parts; rows without an id or a title are left out.

    ``words`` is empty where the title is a stand-in; such rows are left out after the cut, as a
    filter pushed below the parsing would parse twice. ``names`` are the distinct words of the authors field, as text.
    """
    rows = reduce(DataFrame.unionByName, sources).filter("id IS NOT NULL AND title IS NOT NULL")
    words = F.split(merged(F.regexp_replace(plain(F.col("authors")), r"[^\p{L}]+", " ")), " ")
    names = F.array_join(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4)), " ")
    acronym = F.coalesce(F.col("authors").rlike(ACRONYM), F.lit(False))
    rows = parsed_titles(rows).withColumn("names", F.coalesce(names, F.lit(""))).withColumn("acronym", acronym)
    return rows.select("id", "src", "ent", "marker", "words", "sub", "names", "acronym", "year")


def misspellings(words: DataFrame) -> DataFrame:
    """(word, fix) for words within reach of one that is FREQUENCY_RATIO times as frequent.

    ``words`` has (word, n). The nearest frequent word wins, then the more frequent, then the first.
    """
    frequent = words.filter(f"n >= {FREQUENCY_RATIO} AND length(word) >= 4")
    rare = words.filter("length(word) >= 3")
    links = segment_links(rare.select(F.lit("w").alias("kind"), F.col("word").alias("key")), frequent.select(F.lit("w").alias("kind"), F.col("word").alias("key"))).filter("edits > 0")
    links = links.join(rare.select(F.col("word").alias("key"), F.col("n").alias("n_key")), "key").join(frequent.select(F.col("word").alias("entity_key"), F.col("n").alias("n_fix")), "entity_key")
    links = links.filter(F.col("n_key") * FREQUENCY_RATIO <= F.col("n_fix"))
    return links.groupBy("key").agg(F.min(F.struct("edits", -F.col("n_fix"), F.col("entity_key").alias("fix"))).alias("m")).select(F.col("key").alias("word"), F.col("m.fix").alias("fix"))


def keyed(rows: DataFrame) -> DataFrame:
    """(id, src, key, mended) of prepared rows: the key hashes the marker and the corrected content words."""
    texts = rows.groupBy("words").agg(F.count("*").alias("n"))
    each = texts.select("words", "n", F.explode(F.split("words", " ")).alias("word"))
    fixes = cut(misspellings(each.groupBy("word").agg(F.sum("n").alias("n"))))
    # The corrections of one title are at most as many as its words.
    mended = each.join(fixes, "word").groupBy("words").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("fixes"), F.first("n").alias("n"))
    narrow = attach(rows.select("id", "src", "marker", "words"), mended, ["words"], "n", "left")
    right = F.when(F.col("fixes").isNull(), F.col("words")).otherwise(F.array_join(F.transform(F.split("words", " "), lambda w: F.coalesce(F.try_element_at("fixes", w), w)), " "))
    return narrow.select("id", "src", F.xxhash64(right, "marker").alias("key"), F.col("fixes").isNotNull().alias("mended"))


def common_names(rows: DataFrame) -> list[str]:
    """Name words that say little; at most 1/COMMON_SHARE of them, whatever the data."""
    counts = rows.select(F.explode(F.split("names", " ")).alias("name")).filter("name != ''").groupBy("name").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r["name"] for r in counts.filter(F.col("n") >= F.lit(max(total * COMMON_SHARE, COMMON_LEAST))).collect()) if total else []


def contenders(rows: DataFrame, keys: DataFrame, common: list[str]) -> DataFrame:
    """Prepared rows whose key occurs in two sources, with names as arrays, rare ones first.

    ``n`` is the rows of the key, ``works`` its distinct works: names and year, or entities where names are missing.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("src").alias("s1"), F.max("src").alias("s2")).filter("s1 < s2").select("key", "n")
    chosen = attach(keys.select("id", "key", "mended"), shared, ["key"], "n").distinct()
    held = rows.drop("marker", "words").distinct().join(chosen, "id")
    names = F.filter(F.split("names", " "), lambda w: w != "")
    usual = (lambda w: w.isin(common)) if common else (lambda w: F.lit(False))
    rare = F.filter(names, lambda w: ~usual(w))
    work = F.when(F.col("names") == "", F.col("ent")).otherwise(F.xxhash64(F.array_sort(names), F.col("year")))
    held = cut(held.withColumn("work", work).withColumn("rare", F.size(rare)).withColumn("names", F.concat(rare, F.filter(names, usual))))
    works = held.groupBy("key", "work").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("works"))
    return attach(held.drop("n", "work"), works, ["key"], "n")


def title_weight(works: Column) -> Column:
    """What an equal key says where so many works have it."""
    return F.greatest(F.lit(TITLE) - F.when(works > 3, F.log(works / 3)).otherwise(0.0), F.lit(LEAST_TITLE))


def slips(words: DataFrame) -> DataFrame:
    """(name, other): words of ``words`` (name) within the reach of a slip, the one slipped having six letters or more.

    A slip is up to two edits, three from ten letters on. By the pigeonhole principle one of the
    parts that a word is cut into, one more than there are edits, stands in the other unchanged.
    """
    words = words.select("name").distinct()
    part = lambda n, k, i: f"int({i} * {n} div ({k} + 1))"
    index = F.expr(f"flatten(transform(array(2, 3), k -> transform(sequence(0, k), i -> struct(k AS k, length(name) AS l, i AS i, substring(name, {part('length(name)', 'k', 'i')} + 1, {part('length(name)', 'k', '(i + 1)')} - {part('length(name)', 'k', 'i')}) AS seg))))")
    begin, size = part("l", "k", "i"), f"({part('l', 'k', '(i + 1)')} - {part('l', 'k', 'i')})"
    low, high = f"greatest(0, {begin} - int((k - length(name) + l) div 2))", f"least(length(name) - {size}, {begin} + int((k + length(name) - l) div 2))"
    place = f"transform(CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END, at -> struct(k AS k, l AS l, i AS i, substring(name, at + 1, {size}) AS seg))"
    probes = F.expr(f"array_distinct(flatten(transform(array(IF(length(name) >= {LONG_NAME}, 3, 2)), k -> flatten(transform(filter(sequence(length(name) - k, length(name) + k), x -> x > k), l -> flatten(transform(sequence(0, k), i -> {place})))))))")
    held = words.filter("length(name) > 3").select(F.col("name").alias("other"), F.explode(index).alias("s")).select("other", "s.*")
    tried = words.filter(f"length(name) >= {SLIP_LEAST}").select("name", F.explode(probes).alias("s")).select("name", "s.*")
    met = tried.join(held, ["k", "l", "i", "seg"]).filter("name != other").select("name", "other", "k").distinct()
    return met.filter(F.levenshtein("name", "other", 3).between(1, F.col("k"))).select("name", "other")


def collapsed(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contenders with equal rows of one entity as one, and their (member, id).

    Rows of one source that no entity holds are one entity when key, subtitle, names and year are
    equal. Equal rows without names say too little for that, unless three works at most have the title.
    The ``id`` of what is left stands for all its rows, ``n`` counts those of the key.
    """
    alone = F.col("ent") == F.xxhash64("src", "id")
    names = F.array_sort("names")
    copy = alone & ((F.size("names") > 0) | (F.col("works") <= 3))
    held = held.withColumn("ent", F.when(copy, F.xxhash64(F.lit("copy"), "src", "key", "sub", names, "year")).otherwise(F.col("ent")))
    held = held.withColumn("member", F.xxhash64("src", "ent", "key", "sub", names, "year", "acronym", "mended"))
    held = cut(held)
    parts = [F.first(c).alias(c) for c in ("key", *SIDE[1:], "works")]
    left = cut(held.groupBy("member").agg(*parts).withColumnRenamed("member", "id"))
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    return attach(left, counts, ["key"], "n"), held.select("member", "id").distinct()


def reaching(rows: DataFrame, names: float) -> DataFrame:
    """``rows`` with the years at which a pair can pass LEAST_SCORE if its names add ``names``.

    ``reach`` is how far known years may be apart, ``open`` whether one may be missing, ``wide`` whether any
    years will do. Rows that no year brings so far are left out. The years' weights fall in this order.
    """
    # A hair below, as the score adds in another order.
    need = F.lit(LEAST_SCORE - names - 1e-9) - F.col("t")
    reach = F.when(need < YEAR_BOTH, 2).when(need < YEAR_NEXT, 1).when(need < YEAR_SAME, 0)
    return rows.withColumn("reach", reach).filter("reach IS NOT NULL").withColumn("open", need < 0.0).withColumn("wide", need < YEAR_DIFFERS)


def candidates(held: DataFrame) -> DataFrame:
    """Pairs of contenders of two sources under one key, with both sides' evidence.

    Keys of up to GENERIC_TITLE rows give all their pairs of different sources. Longer ones give all
    that title, names and year can bring above LEAST_SCORE, so the pairs that are scored above it are the same
    either way: pairs that share a name word or have one within a slip of the other's, pairs of which a
    side has no names or an acronym, and all others where the title bears other names. Each kind meets at
    the years that its best score allows. ``known`` is taken within the whole key.
    """
    side = lambda df, x, *more: df.select("key", *more, *[F.col(c).alias(f"{x}_{c}") for c in PAIRED])
    few, many = held.filter(F.col("n") <= GENERIC_TITLE), held.filter(F.col("n") > GENERIC_TITLE)
    # Two words that two sources both have under the key are two people's names, not one name slipped.
    title = F.collect_list(F.struct("src", "names")).over(Window.partitionBy("key"))
    few = few.withColumn("_title", title).withColumn("known", F.filter("names", lambda w: F.exists("_title", lambda r: (r["src"] != F.col("src")) & F.array_contains(r["names"], w)))).drop("_title")
    specific = side(few, "a", "works").join(side(few, "b"), "key").filter("a_src < b_src")
    if not many.head(1):
        return specific
    rows = many.select("key", "id", "src", "names", "year", title_weight(F.col("works")).alias("t"), ((F.size("names") == 0) | F.col("acronym")).alias("lone"))
    named = reaching(rows.withColumn("name", F.explode("names")), AUTHORS_AGREE).select("key", "id", "src", "year", "name", "reach", "open", "wide")
    as_name = lambda df, name: df.withColumn("name", name).select(*named.columns)
    words = cut(named.groupBy("key", "name").agg((F.min("src") < F.max("src")).alias("known")))
    links = words.join(slips(words), "name").join(words.select("key", F.col("name").alias("other"), F.col("known").alias("too")), ["key", "other"])
    known = named.join(words.filter("known"), ["key", "name"]).groupBy("key", "id").agg(F.collect_set("name").alias("known"))
    many = cut(many.join(known, ["key", "id"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))))
    slipped = named.join(cut(links.filter("NOT (known AND too)").select("key", "name", "other")), ["key", "name"]).drop("name").withColumnRenamed("other", "name").select(*named.columns)
    # Names are letters only, so these stand for no name: 0 where other names will do, 1 for a left side without names, 2 for the right alone.
    silent, strange = reaching(rows, 0.0), as_name(reaching(rows, AUTHORS_DIFFER), F.lit("0"))
    left = named.unionByName(slipped).unionByName(strange).unionByName(as_name(silent, F.when(F.col("lone"), "1").otherwise("2")))
    right = named.unionByName(strange).unionByName(as_name(silent, F.lit("1"))).unionByName(as_name(silent.filter("lone"), F.lit("2")))
    # Places where two rows meet: 0 all years, 1 a year missing left, 2 a year missing right only, else the year.
    place = lambda *options: F.explode(F.filter(F.flatten(F.array(*options)), lambda p: p.isNotNull()))
    year, missing, narrow = F.col("year"), F.col("year").isNull(), ~F.col("wide")
    at_left = place(F.array(F.when(F.col("wide"), 0), F.when(narrow, year), F.when(narrow & F.col("open"), F.when(missing, 1).otherwise(2))))
    years = F.when(narrow & ~missing, F.sequence(year - F.col("reach"), year + F.col("reach"))).otherwise(F.array().cast("array<int>"))
    at_right = place(F.array(F.when(F.col("wide"), 0), F.when(narrow & F.col("open"), 1), F.when(narrow & F.col("open") & missing, 2)), years)
    a = left.select("key", "name", at_left.alias("at"), F.col("id").alias("a_id"), F.col("src").alias("a_src"))
    b = right.select("key", "name", at_right.alias("at"), F.col("id").alias("b_id"), F.col("src").alias("b_src"))
    met = a.join(b, ["key", "name", "at"]).filter("a_src < b_src").select("key", "a_id", "b_id").distinct()
    generic = met.join(side(many, "a", "works"), ["key", "a_id"]).join(side(many, "b"), ["key", "b_id"])
    return specific.unionByName(generic)


def scored(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, a_src, b_src, a_ent, b_ent, theta) for pairs that names can still carry; those out of question are left out after the cut."""
    a, b = F.col("a_names"), F.col("b_names")
    apart = F.abs(F.col("a_year") - F.col("b_year"))
    year = F.when(apart.isNull(), 0.0).when(apart == 0, YEAR_SAME).when(apart == 1, YEAR_NEXT).when(apart == 2, YEAR_BOTH).otherwise(YEAR_DIFFERS)
    near = (F.col("a_sub") == F.col("b_sub")) | F.levenshtein("a_sub", "b_sub", 3).between(0, 3)
    sub = F.when(near, 0.0).when((F.col("a_sub") == "") | (F.col("b_sub") == ""), SUBTITLE_MISSING).otherwise(SUBTITLE_DIFFERS)
    title = title_weight(F.col("works")) - F.when(F.col("a_mended") | F.col("b_mended"), 1.0).otherwise(0.0)
    hopeful = pairs.withColumn("theta", title + year + sub).filter(F.col("theta") + AUTHORS_AGREE > LEAST_SCORE)
    first = lambda x: F.slice(F.col(f"{x}_names"), F.lit(1), F.col(f"{x}_rare"))
    weight = lambda x: F.col(f"{x}_rare") + COMMON_WEIGHT * (F.size(f"{x}_names") - F.col(f"{x}_rare"))
    hopeful = hopeful.withColumn("_both", F.size(F.array_intersect(a, b))).withColumn("_rare", F.when(F.col("_both") == 0, 0).otherwise(F.size(F.array_intersect(first("a"), first("b")))))
    hopeful = hopeful.withColumn("_least", F.least(weight("a"), weight("b"))).withColumn("_shared", F.col("_rare") + COMMON_WEIGHT * (F.col("_both") - F.col("_rare")))
    shared, least, rare = F.col("_shared"), F.col("_least"), F.col("_rare")
    within = lambda x, y: F.levenshtein(x, y, 3).between(1, F.when(F.length(x) >= LONG_NAME, 3).otherwise(2))
    two = lambda x, y: F.array_contains("a_known", x) & F.array_contains("b_known", y)
    slip = F.exists(a, lambda x: F.exists(b, lambda y: (F.length(x) >= SLIP_LEAST) & (x != y) & within(x, y) & ~two(x, y)))
    names = (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when((shared * 2 > least) | ((shared * 2 == least) & (rare > 0)), AUTHORS_AGREE)
        .when(slip, F.when((shared + 1) * 2 >= least, AUTHORS_AGREE).otherwise(AUTHORS_PART))
        .when(F.col("a_acronym") | F.col("b_acronym"), 0.0)
        .otherwise(F.when(rare > 0, AUTHORS_PART).otherwise(AUTHORS_DIFFER))
    )
    return hopeful.withColumn("theta", F.col("theta") + names).select("a_id", "b_id", "a_src", "b_src", "a_ent", "b_ent", "theta")


def _message(edges: DataFrame, ent: str, other: str, incoming: Column, out: str) -> DataFrame:
    """The factor of ``ent`` towards source ``other`` to each of its pairs: minus log(1 + what the others weigh)."""
    # The evidence sums to far less than the clamp; below it a rival of the least score still counts beside the greatest.
    weight = F.exp(F.least(incoming, F.lit(20.0)))
    sums = edges.groupBy(ent, other).agg(F.sum(weight).alias("_sum"))
    return edges.join(sums, [ent, other]).withColumn(out, (1 - DAMPING) * F.col(out) - DAMPING * F.log1p(F.greatest(F.col("_sum") - weight, F.lit(0.0)))).drop("_sum")


def belief(scores: DataFrame) -> DataFrame:
    """(a_ent, b_ent, confidence): marginal probability of each pair of entities.

    Pairs without a rival need no message. The others exchange messages until none moves by more
    than TOLERANCE; every round is cut off in the shared folder, the one before it removed. Messages
    that still move after MOST_ROUNDS are taken as they are, and a warning tells by how much.
    """
    edges = scores.groupBy("a_ent", "b_ent", "a_src", "b_src").agg(F.max("theta").alias("theta"))
    for ent, other in (("a_ent", "b_src"), ("b_ent", "a_src")):
        rivals = edges.groupBy(ent, other).agg(F.count("*").alias(f"{ent}_n"))
        edges = edges.join(rivals, [ent, other])
    edges = cut(edges)
    free = edges.filter("a_ent_n = 1 AND b_ent_n = 1").select("a_ent", "b_ent", "theta")
    live = edges.filter("a_ent_n > 1 OR b_ent_n > 1").drop("a_ent_n", "b_ent_n").withColumn("ma", F.lit(0.0)).withColumn("mb", F.lit(0.0))
    table, moved = None, None
    for _ in range(MOST_ROUNDS):
        new = live.withColumn("was", F.col("ma") + F.col("mb"))
        new = _message(new, "a_ent", "b_src", F.col("theta") + F.col("mb"), "ma")
        new = cut(_message(new, "b_ent", "a_src", F.col("theta") + F.col("ma"), "mb"))
        moved = new.agg(F.max(F.abs(F.col("ma") + F.col("mb") - F.col("was")))).first()[0]
        if table is not None:
            discard(table)
        table, live = new, new.drop("was")
        if moved is None or moved < TOLERANCE:
            break
    else:
        logging.getLogger(__name__).warning("belief propagation stopped after %d rounds, messages still moving by %g", MOST_ROUNDS, moved)
    both = free.unionByName(live.select("a_ent", "b_ent", (F.col("theta") + F.col("ma") + F.col("mb")).alias("theta")))
    return both.select("a_ent", "b_ent", (1 / (1 + F.exp(-F.col("theta")))).alias("confidence"))


def match_entities(sources: Sequence[DataFrame]) -> DataFrame:
    """(left_id, right_id, confidence), left_id < right_id, for every scored pair of records of two sources.

    Records without a usable title match nothing; missing names or years are no evidence. Repeated
    rows count once. Empty sources give no pairs.
    """
    rows = cut(prepared(sources)).filter("words != ''")
    held, members = collapsed(contenders(rows, cut(keyed(rows)), common_names(rows)))
    scores = cut(scored(candidates(cut(held)))).filter(F.col("theta") > LEAST_SCORE)
    out = scores.join(belief(scores), ["a_ent", "b_ent"]).select(F.col("a_id").alias("a_member"), F.col("b_id").alias("b_member"), "confidence")
    for x in ("a", "b"):
        out = out.join(members.select(F.col("member").alias(f"{x}_member"), F.col("id").alias(f"{x}_id")), f"{x}_member")
    return out.groupBy(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id")).agg(F.max("confidence").alias("confidence"))


def same_works(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs that are more likely one entity than not."""
    return matches.filter(F.col("confidence") > least).select("left_id", "right_id")
