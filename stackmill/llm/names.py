"""Linking names typed by people to a reference list (problem 5).

A pigeonhole segment join: a reference key is cut into one segment more than the edits it bears;
when a typed key is within them, one segment occurs in it unchanged, shifted by a bounded number of
places. Typed keys look their shifted substrings up in the inverted index of segments, candidates
are verified with Spark's banded edit distance, and the other parts of the name decide among them.
Everything runs in the JVM on distinct typed names; records meet their result at the end.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.plans.skew import attach
from stackmill.session import cut

EDITS = 2

# Short forms of given names and what they stand for, and abbreviations in names of organisations.
NICKNAMES = {
    "alex": ["alexander", "alexandra"], "sasha": ["alexander", "alexandra"], "sandy": ["alexander", "alexandra"], "tony": ["anthony"], "ben": ["benjamin"], "benny": ["benjamin"],
    "charlie": ["charles", "charlotte"], "chuck": ["charles"], "chris": ["christopher", "christian", "christina"], "kit": ["christopher"], "dan": ["daniel"], "danny": ["daniel"],
    "deb": ["deborah"], "debbie": ["deborah"], "debby": ["deborah"], "ed": ["edward", "edmund", "edgar"], "eddie": ["edward", "edmund"], "ned": ["edward"], "ted": ["theodore", "edward"], "teddy": ["theodore", "edward"], "theo": ["theodore"],
    "beth": ["elizabeth"], "betty": ["elizabeth"], "liz": ["elizabeth"], "lizzie": ["elizabeth"], "eliza": ["elizabeth"], "lisa": ["elizabeth"], "paco": ["francisco"], "pancho": ["francisco"], "frank": ["francis", "francisco", "franklin"], "fritz": ["friedrich"], "fred": ["frederick", "friedrich"],
    "greg": ["gregory"], "hans": ["johannes"], "jan": ["johannes"], "jen": ["jennifer"], "jenny": ["jennifer"], "jim": ["james"], "joe": ["joseph"], "joey": ["joseph"], "jack": ["john"], "johnny": ["john"],
    "kate": ["katherine", "catherine"], "kathy": ["katherine"], "katie": ["katherine"], "kat": ["katherine"], "kitty": ["katherine"], "maggie": ["margaret"], "meg": ["margaret"], "peggy": ["margaret"], "marge": ["margaret"], "greta": ["margaret"], "matt": ["matthew"],
    "mike": ["michael"], "mick": ["michael"], "mickey": ["michael"], "nick": ["nicholas"], "nicky": ["nicholas"], "pat": ["patricia", "patrick"], "patty": ["patricia"], "trish": ["patricia"], "tricia": ["patricia"],
    "rafa": ["rafael"], "rafe": ["rafael"], "rich": ["richard"], "rick": ["richard"], "ricky": ["richard"], "dick": ["richard"], "bob": ["robert"], "bobby": ["robert"], "rob": ["robert"], "robbie": ["robert"], "bert": ["robert", "albert"],
    "sam": ["samuel", "samantha"], "sammy": ["samuel"], "sue": ["susan"], "susie": ["susan"], "suzy": ["susan"], "tom": ["thomas"], "tommy": ["thomas"], "toby": ["tobias"], "vicky": ["victoria"], "vicki": ["victoria"], "tori": ["victoria"],
    "bill": ["william"], "billy": ["william"], "will": ["william"], "willy": ["william"], "liam": ["william"], "walt": ["walter"], "hank": ["henry"], "harry": ["henry", "harold"],
}
ABBREVIATIONS = {"inst": "institute", "ctr": "centre", "cent": "centre", "center": "centre", "lab": "laboratory", "labs": "laboratory", "consort": "consortium", "univ": "university", "dept": "department", "dep": "department", "intl": "international", "int": "international", "natl": "national", "soc": "society", "sect": "section", "sec": "section", "res": "research", "assoc": "association", "acad": "academy", "fac": "faculty", "col": "college"}
HONORIFICS = ["prof", "professor", "dr", "mr", "mrs", "phd"]
MINOR_WORDS = ["for", "of", "on", "and", "the", "in", "at"]


def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters, by decomposition."""
    marked, base = [], []
    for point in range(0xC0, 0x250):
        flat = unicodedata.normalize("NFD", chr(point).lower())
        if flat[0].isascii() and chr(point).lower() == chr(point) and len(flat) > 1:
            marked.append(chr(point))
            base.append(flat[0])
    return "".join(marked) + "øłđħıŧ", "".join(base) + "oldhit"


#: Accented letters and their base letters.
ACCENTS = _accents()


def unaccented(value: Column) -> Column:
    """Lower case without accents; text of one byte per character has none."""
    low = F.lower(value)
    flat = F.replace(F.regexp_replace(F.translate(low, *ACCENTS), r"\p{M}", ""), F.lit("ß"), F.lit("ss"))
    return F.when(F.octet_length(value) == F.length(value), low).otherwise(flat)


def merged(flat: Column) -> Column:
    """The two-letter spellings of umlauts as the plain letter."""
    for pair, letter in (("oe", "o"), ("œ", "o"), ("ae", "a"), ("æ", "a"), ("ue", "u")):
        flat = F.replace(flat, F.lit(pair), F.lit(letter))
    return flat


def fold(value: Column) -> Column:
    """Lower case without accents and umlauts in either spelling."""
    return merged(unaccented(value))


def _organisation_key(folded: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(folded, "&", " and "), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(F.when(F.try_element_at(words, F.lit(1)) == "the", F.slice(words, 2, 1_000_000)).otherwise(words), " ")


def _acronym(key: Column) -> Column:
    words = F.filter(F.split(key, " "), lambda w: ~w.isin(MINOR_WORDS) & (w != ""))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def typed_readings(typed: DataFrame) -> DataFrame:
    """(name, kind, key, given): the readings of each typed name.

    Kinds: ``p`` a person (key is the family name), ``o`` an organisation (key is its name in full
    words), ``a`` a single word that may be an acronym. Names in which the order of the parts is
    open have two readings; names of five or more words are read as an organisation and as a person.
    Titles of persons are no part of the name.
    """
    titles = rf"(?<![^\s,])(?:{'|'.join(HONORIFICS)})\.?(?=[\s,]|$)"
    # One column after the other, so that each is computed once.
    rows = typed.select("name", F.trim(F.regexp_replace(unaccented(F.col("name")), r"[\"{}“”\[\]]", " ")).alias("f"))
    rows = rows.withColumn("f", F.when(F.col("f").rlike(r"[js]r\.?\s*$"), F.regexp_replace("f", r",?\s*\b(jr|sr)\b\.?\s*$", "")).otherwise(F.col("f")))
    rows = rows.withColumn("f", F.when(F.col("f").rlike(titles), F.regexp_replace(F.regexp_replace("f", titles, " "), r"^[\s,]+|[\s,]+$", "")).otherwise(F.col("f")))
    rows = rows.withColumn("w", F.filter(F.split(F.regexp_replace("f", r"[\s,]+", " "), " "), lambda w: w != "")).filter("size(w) > 0")
    n = F.size("w")
    reading = lambda kind, key, given: F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key"), given.alias("given")))
    organisation = reading("o", F.col("f"), F.lit(""))
    before, after = F.trim(F.split_part("f", F.lit(","), F.lit(1))), F.trim(F.regexp_replace("f", r"^[^,]*,\s*", ""))
    joined = lambda start: F.array_join(F.slice("w", start, F.greatest(n - 1, F.lit(1))), " ")
    person = F.when(F.contains("f", F.lit(",")), F.concat(reading("p", before, after), reading("p", after, before))).otherwise(F.concat(reading("p", F.element_at("w", -1), joined(1)), reading("p", F.element_at("w", 1), joined(2))))
    read = F.when(F.col("f").rlike(r"\b(for|of|on|and)\b|&"), organisation).when(n == 1, reading("a", F.replace(F.element_at("w", 1), F.lit(".")), F.lit(""))).when(n >= 5, F.concat(organisation, person)).otherwise(person)
    each = rows.select("name", F.inline(read))
    return each.withColumn("key", merged(F.when(F.col("kind") == "o", _organisation_key(F.col("key"))).otherwise(F.col("key"))))


def reference_entities(df: DataFrame) -> DataFrame:
    """(kind, key, entity_id, given, middle) of the reference list; organisations have their acronym as a second key.

    Rows without an id or a family name are left out; repeated rows count once.
    """
    base = df.select(F.col("entity_id").cast("bigint").alias("entity_id"), F.lower("kind").alias("what"), "family", unaccented(F.coalesce("given", F.lit(""))).alias("given"), F.substring(unaccented(F.coalesce("middle", F.lit(""))), 1, 1).alias("middle")).filter("entity_id IS NOT NULL AND trim(family) != ''")
    people = base.filter("what = 'person'").select(F.lit("p").alias("kind"), F.trim(fold(F.col("family"))).alias("key"), "entity_id", "given", "middle")
    orgs = base.filter("what != 'person'").select("entity_id", _organisation_key(fold(F.col("family"))).alias("key"), F.lit("").alias("given"), F.lit("").alias("middle"))
    full, short = orgs.withColumn("kind", F.lit("o")), orgs.withColumn("key", _acronym(F.col("key"))).withColumn("kind", F.lit("a"))
    return people.unionByName(full).unionByName(short).distinct()


def _reach(length: str) -> str:
    """Edits that a reference key of this length bears: one per four letters, EDITS at most."""
    return f"least({EDITS}, {length} div 4)"


def _start(place: str, length: str) -> str:
    """Where a segment of a key begins, counted from 0; a key has one segment more than edits."""
    return f"int({place} * {length} div ({_reach(length)} + 1))"


def _segments() -> Column:
    """Segments of a reference key: (len, i, seg)."""
    size = "length(key)"
    return F.expr(f"transform(sequence(0, {_reach(size)}), i -> struct({size} AS len, i AS i, substring(key, {_start('i', size)} + 1, {_start('(i + 1)', size)} - {_start('i', size)}) AS seg))")


def _probes() -> Column:
    """Substrings of a typed key at every place where a segment of a key of a near length can lie."""
    start, size = _start("i", "l"), f"({_start('(i + 1)', 'l')} - {_start('i', 'l')})"
    low = f"greatest(0, {start} - int(({_reach('l')} - length(key) + l) div 2))"
    high = f"least(length(key) - {size}, {start} + int(({_reach('l')} + length(key) - l) div 2))"
    place = f"transform(CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END, at -> struct(l AS len, i AS i, substring(key, at + 1, {size}) AS seg))"
    return F.expr(f"flatten(transform(filter(sequence(length(key) - {EDITS}, length(key) + {EDITS}), x -> x >= 4 AND abs(x - length(key)) <= {_reach('x')}), l -> flatten(transform(sequence(0, {_reach('l')}), i -> {place}))))")


def _letters(key: str) -> Column:
    return F.array_join(F.array_sort(F.split(key, "")), "")


def segment_links(typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(kind, key, entity_key, edits): every typed key within reach of a reference key.

    ``typed`` and ``reference`` have (kind, key). Reach is one edit per four letters, EDITS at most,
    or one swap of letters; acronyms and keys of one or two letters must be equal. A reference key
    is cut into as many segments as its reach needs, so that segments stay long; swaps within keys
    of less than eight letters, which may spoil both segments, are found by their equal letters.
    """
    reference, typed = reference.select("kind", F.col("key")).distinct(), typed.select("kind", "key").distinct()
    index = reference.filter("kind != 'a' AND length(key) >= 4").withColumn("s", F.explode(_segments())).select("kind", F.col("key").alias("entity_key"), "s.*")
    probes = typed.filter(f"kind != 'a' AND length(key) > {EDITS}").withColumn("s", F.explode(_probes())).select("kind", "key", "s.*")
    edits = F.levenshtein("key", "entity_key", EDITS)
    near = probes.join(index, ["kind", "len", "i", "seg"]).select("kind", "key", "entity_key").withColumn("edits", edits).filter((F.col("edits") >= 0) & (F.col("edits") <= F.expr(_reach("length(entity_key)"))))
    short = "kind != 'a' AND length(key) BETWEEN 3 AND 7"
    mixed = typed.filter(short).withColumn("_l", _letters("key")).join(reference.filter(short).select("kind", F.col("key").alias("entity_key"), _letters("key").alias("_l")), ["kind", "_l"]).select("kind", "key", "entity_key").withColumn("edits", edits).filter("edits >= 0")
    near = near.unionByName(mixed).distinct()
    same = typed.join(reference, ["kind", "key"]).filter(f"kind = 'a' OR length(key) <= {EDITS}").select("kind", "key", F.col("key").alias("entity_key"), F.lit(0).alias("edits"))
    return near.unionByName(same)


def _given_cost(typed: Column, full: Column) -> Column:
    """0 equal or initial, 1 short form or slip of the pen, null another name."""
    table = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    edits = F.levenshtein(typed, full, 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (edits == 2) & (F.length(typed) == F.length(full)) & (letters(typed) == letters(full))
    return (
        F.when((typed == "") | (full == ""), F.lit(None))
        .when(typed == full, 0)
        .when(F.length(typed) == 1, F.when(F.substring(full, 1, 1) == typed, 0))
        .when(F.coalesce(F.array_contains(F.try_element_at(table, typed), full), F.lit(False)), 1)
        .when((edits == 1) & (F.length(full) >= 4), 1)
        .when(swapped | ((edits == 2) & (F.length(full) >= 8)), 1)
    )


def resolve_names(typed: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, edits) for each distinct typed name that means exactly one entity.

    A given name must be equal, a short form, an initial or a slip of the entity's; a typed middle
    initial must be the entity's. When two entities fit equally well the name stays unlinked.
    """
    readings = typed_readings(typed.select("name"))
    readings = readings.withColumn("words", F.filter(F.split(F.col("given"), r"[\s.\-]+"), lambda w: w != ""))
    readings = readings.withColumn("first", F.coalesce(F.try_element_at("words", F.lit(1)), F.lit(""))).withColumn("second", F.substring(F.coalesce(F.try_element_at("words", F.lit(2)), F.lit("")), 1, 1)).drop("words", "given")
    readings = cut(readings)
    links = segment_links(readings, entities)
    met = readings.join(links, ["kind", "key"]).join(entities.withColumnRenamed("key", "entity_key"), ["kind", "entity_key"])
    given = F.least(_given_cost(F.col("first"), F.col("given")), _given_cost(merged(F.col("first")), merged(F.col("given"))))  # least skips nulls
    cost = F.when(F.col("kind") == "p", F.when((F.col("second") == "") | (F.col("second") == F.col("middle")), given)).otherwise(F.lit(0))
    fit = met.withColumn("cost", cost).filter("cost IS NOT NULL").withColumn("edits", F.col("edits") + F.col("cost"))
    best = fit.groupBy("name", "entity_id").agg(F.min("edits").alias("edits"))
    # The least and the greatest entity at the least cost are the same exactly when there is one.
    ends = best.groupBy("name").agg(F.min(F.struct("edits", "entity_id")).alias("a"), F.max(F.struct(-F.col("edits"), F.col("entity_id"))).alias("b"))
    return ends.filter("a.entity_id = b.entity_id").select("name", F.col("a.entity_id").alias("entity_id"), F.col("a.edits").alias("edits"))


def link_names(names: DataFrame, reference: DataFrame) -> DataFrame:
    """(record_id, pos, entity_id) for every name of ``names`` (record_id, pos, name) that means an entry.

    Null, blank and unreadable names give no row; repeated rows count once; a name of any length is
    read whole; empty tables give none.
    """
    names = cut(names.filter("trim(name) != ''").select("record_id", "pos", F.trim("name").alias("name")))
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    resolved = cut(resolve_names(counted, reference_entities(reference)))
    return attach(names, counted.join(resolved, "name"), ["name"], "n").select("record_id", "pos", "entity_id").distinct()
