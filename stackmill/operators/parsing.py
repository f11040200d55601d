"""Items of mixed text, bibliographies and their entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackmill.functions.grammar import CITATION_WORDS, HEADINGS, bibtex_entry, bibtex_spans, dois, parse, reference_value

# Patterns of names, years and numbered entries in references.
AUTHOR = r"(\p{Lu}[\p{L}'`\-]+,\s*(?:\p{Lu}\.|\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)*))"
ET_AL = r"(\p{Lu}[\p{L}'`\-]+\s+et al\.)"
NUMBERED = r"^\s*(?:\[[0-9]{1,3}\]|[0-9]{1,3}[.)])\s*(?=.)"
AUTHOR_START, YEAR_START = r"^\p{Lu}[\p{L}'`\-]+,\s*(?:\p{Lu}\.|\p{Lu}\p{L}+)", r"^\(?[0-9]{4}\)?\b"
YEAR = r"\b(?:18|19|20)[0-9]{2}\b"
MAX_YEAR = 2100
KINDS = ["url", "doi", "reference", "bibtex", "unknown"]


def parsed_texts(texts: DataFrame) -> DataFrame:
    """(input_id, ord, phase, kind, raw, value) of (input_id, text): the items in the contractual order, then what was set apart.

    What was set apart has kind ``skipped`` and its message as value. A null text gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["input_id"], batch["text"], strict=True):
                found = parse(text)
                rows += [(i, n, *item) for n, item in enumerate([*found.items, *((9, "skipped", m, m) for m in found.skipped)], 1)]
            yield pd.DataFrame(rows, columns=["input_id", "ord", "phase", "kind", "raw", "value"])

    return texts.select("input_id", "text").filter("text IS NOT NULL").mapInPandas(run, "input_id bigint, ord int, phase int, kind string, raw string, value string")


def parsed_items(texts: DataFrame) -> DataFrame:
    """The items of ``parsed_texts``."""
    return parsed_texts(texts).filter("kind != 'skipped'")


def skipped_parts(texts: DataFrame) -> DataFrame:
    """(input_id, ord, message) of what was set apart."""
    return parsed_texts(texts).filter("kind = 'skipped'").select("input_id", "ord", F.col("value").alias("message"))


def with_file_items(parsed: DataFrame, of_files: DataFrame) -> DataFrame:
    """(input_id, part, ord, kind, value): items of texts (part 0), then those of bibliography files (part 1), each in their order."""
    pick = lambda df, part: df.filter("kind != 'skipped'").select("input_id", F.lit(part).alias("part"), "ord", "kind", "value")
    return pick(parsed, 0).unionByName(pick(of_files, 1))


def type_counts(parsed: DataFrame) -> DataFrame:
    """Items per kind, as one row."""
    return parsed.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_items") for k in KINDS])


def _year_found(text: Column, max_year: int) -> Column:
    """(year, at, end): the first year in parentheses within 1800 and ``max_year``, else the first bare one, with its places."""
    within = lambda years: F.filter(years, lambda y: y.cast("int").between(1800, max_year))
    first = lambda pattern: F.try_element_at(within(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), F.lit(1))
    found = lambda year, at: F.when(year.isNotNull(), F.struct(year.alias("year"), at.alias("at"), (at + 4).alias("end")))
    closed, bare = first(r"\(([0-9]{4})\)"), first(r"\b((?:18|19|20)[0-9]{2})\b")
    return F.coalesce(found(closed, F.position(F.concat(F.lit("("), closed, F.lit(")")), text) + 1), found(bare, F.regexp_instr(text, F.concat(F.lit("\\b"), bare, F.lit("\\b")))))


def reference_year(text: Column, max_year: int = MAX_YEAR) -> Column:
    """First year in parentheses within 1800 and ``max_year``, else the first bare one."""
    return _year_found(text, max_year)["year"].cast("int")


def reference_authors(text: Column, max_year: int = MAX_YEAR) -> Column:
    """Authors before the year: one ``X et al.``, or every ``Family, Given`` form."""
    at = _year_found(text, max_year)["at"]
    before = F.trim(F.when(at.isNotNull(), F.left(text, at - 1)).otherwise(text))
    before = F.trim(F.regexp_replace(before, r"^[0-9.\[\]]+", ""))
    et_al = F.nullif(F.regexp_extract(before, ET_AL, 1), F.lit(""))
    return F.when(et_al.isNotNull(), F.array(et_al)).otherwise(F.regexp_extract_all(before, F.lit(AUTHOR), F.lit(1)))


def reference_title(text: Column, max_year: int = MAX_YEAR) -> Column:
    """Text after the year up to a full stop; else the longest capitalised segment, the last of equal ones."""
    end = _year_found(text, max_year)["end"]
    after = F.trim(F.regexp_replace(F.substring(text, end, F.length(text)), r"^[\s).,:;\-]+", ""))
    clean = lambda t: F.regexp_replace(F.trim(F.trim(F.trim(t), F.lit('"')), F.lit("'")), r"\.+$", "")
    anchored = clean(F.split_part(after, F.lit(". "), F.lit(1)))
    segments = F.filter(F.transform(F.split(text, r"[.;!?]"), lambda p: F.trim(p)), lambda s: (F.octet_length(s) > 10) & s.rlike(r"^\p{Lu}"))
    longest = F.array_max(F.transform(segments, lambda s, i: F.struct(F.octet_length(s).alias("n"), i.alias("i"), s.alias("s"))))["s"]
    return F.when(end.isNotNull() & (F.octet_length(anchored) >= 3), anchored).otherwise(F.when(F.octet_length(clean(longest)) >= 3, clean(longest)))


def confidence(authors: Column, year: Column, title: Column) -> Column:
    """high, medium or low: how many of authors, year and title were found."""
    found = (F.size(authors) > 0).cast("int") + year.isNotNull().cast("int") + title.isNotNull().cast("int")
    return F.when(found == 3, "high").when(found == 2, "medium").otherwise("low")


def references(texts: DataFrame, max_year: int = MAX_YEAR) -> DataFrame:
    """(input_id, authors, year, title, confidence) of (input_id, text), one reference per text."""
    out = texts.select("input_id", reference_authors(F.col("text"), max_year).alias("authors"), reference_year(F.col("text"), max_year).alias("year"), reference_title(F.col("text"), max_year).alias("title"))
    return out.withColumn("confidence", confidence(F.col("authors"), F.col("year"), F.col("title")))


def is_reference_line(line: Column) -> Column:
    """Longer than 20 bytes, and with a year, three commas or a word of citations."""
    text = F.trim(line)
    words = F.lower(text).rlike("|".join(w.replace(".", r"\.") for w in CITATION_WORDS))
    return F.coalesce((F.octet_length(text) > 20) & (text.rlike(YEAR) | (F.regexp_count(text, F.lit(",")) >= 3) | words), F.lit(False))


def is_reference_like(entry: Column) -> Column:
    """At least 20 bytes, with a year and another sign of a reference, or with several of the others."""
    commas, stops = F.regexp_count(entry, F.lit(",")), F.regexp_count(entry, F.lit(r"\."))
    word = F.lower(entry).rlike("|".join(w.replace(".", r"\.") for w in CITATION_WORDS))
    listed = (commas >= 2) | (stops >= 2) | entry.rlike(AUTHOR_START)
    year = entry.rlike(YEAR)
    return F.coalesce((F.octet_length(entry) >= 20) & ((commas >= 3) | (listed & (word | year)) | (word & year)), F.lit(False))


def bibliography_entries(texts: DataFrame) -> DataFrame:
    """(input_id, entry_no, entry) of (input_id, text): blocks at blank lines, entries inside blocks, those that look like references.

    A new entry begins with a number, or, after a line that ends in a full stop, with an author or a
    year. Headings and lines of punctuation are left out. Windows run within one text. ``entry_no``
    counts all entries of the text, also those that do not look like references.
    """
    lines = texts.select("input_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    order = Window.partitionBy("input_id").orderBy("no")
    lines = lines.withColumn("block", F.sum((F.col("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heading = F.lower(F.trim(F.regexp_replace("line", r":+$", ""))).isin(HEADINGS) | F.col("line").rlike(r"^[\p{Punct}\s]*$")
    kept = lines.filter(~heading).withColumn("numbered", F.col("line").rlike(NUMBERED)).withColumn("line", F.regexp_replace("line", NUMBERED, "")).filter("line != ''")
    within = Window.partitionBy("input_id", "block").orderBy("no")
    start = F.lag("line").over(within).isNull() | F.col("numbered") | (F.lag("line").over(within).endswith(".") & (F.col("line").rlike(AUTHOR_START) | F.col("line").rlike(YEAR_START)))
    kept = kept.withColumn("_start", start.cast("int"))
    kept = kept.withColumn("entry_no", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    grouped = kept.groupBy("input_id", "entry_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("entry"))
    return grouped.filter(is_reference_like(F.col("entry")))


def bibliographies(texts: DataFrame, max_year: int = MAX_YEAR) -> DataFrame:
    """Entries with what was found in them and ``accepted``: not low in confidence, or with authors or a year."""
    out = bibliography_entries(texts).withColumn("authors", reference_authors(F.col("entry"), max_year)).withColumn("year", reference_year(F.col("entry"), max_year)).withColumn("title", reference_title(F.col("entry"), max_year))
    out = out.withColumn("confidence", confidence(F.col("authors"), F.col("year"), F.col("title")))
    return out.withColumn("accepted", (F.col("confidence") != "low") | (F.size("authors") > 0) | F.col("year").isNotNull())


def bibliography_summary(entries: DataFrame) -> DataFrame:
    """(found, parsed, uncertain) of ``bibliographies``, as one row."""
    return entries.agg(F.count("*").alias("found"), F.count_if("accepted").alias("parsed"), F.count_if(~F.col("accepted")).alias("uncertain"))


def ris_records(texts: DataFrame) -> DataFrame:
    """(input_id, record_no, fields, ended) of RIS files: records from TY to ER, tags with their values in order.

    A record that the next TY cuts off is there too, with ``ended`` false.
    """
    lines = texts.select("input_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    order = Window.partitionBy("input_id").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("record_no", F.sum(F.col("line").rlike(r"^TY  -(?: |$)").cast("int")).over(order)).filter("record_no > 0")
    ended = F.sum(F.col("line").rlike(r"^ER  -(?: |$)").cast("int")).over(Window.partitionBy("input_id", "record_no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    tagged = lines.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0").filter(F.col("line").rlike(r"^[A-Z][A-Z0-9]  -(?: |$)"))
    pair = F.struct("no", F.substring("line", 1, 2).alias("tag"), F.trim(F.substring(F.col("line"), F.lit(6), F.length("line"))).alias("value"))
    return tagged.groupBy("input_id", "record_no").agg(F.array_sort(F.collect_list(pair)).alias("fields"), F.bool_or(F.col("line").startswith("ER  -")).alias("ended"))


@F.pandas_udf(T.StringType())
def first_doi(values: pd.Series) -> pd.Series:
    """The first DOI in a text; null where there is none."""
    return values.map(lambda v: next((d for _, d in dois(v)), None), na_action="ignore")


def ris_entries(records: DataFrame) -> DataFrame:
    """One row per record: the first value of each tag, all authors, and ``problem`` where it is to be skipped."""
    of = lambda tag: F.filter("fields", lambda f: (f["tag"] == tag) & (f["value"] != ""))
    first = lambda tag: F.try_element_at(of(tag), F.lit(1))["value"]
    year = F.try_element_at(F.filter(F.transform(of("PY"), lambda f: F.regexp_extract(f["value"], f"({YEAR})", 1)), lambda y: y != ""), F.lit(1)).cast("int")
    doi = first_doi(F.array_join(F.transform(of("DO"), lambda f: f["value"]), "\n"))
    problem = F.when(first("TY").isNull(), "no type").when(~F.col("ended"), "not closed by an end line")
    return records.select("input_id", "record_no", first("TY").alias("entry_type"), first("TI").alias("title"), F.transform(of("AU"), lambda f: f["value"]).alias("authors"), year.alias("year"), doi.alias("doi"), first("UR").alias("url"), problem.alias("problem"))


def ris_items(entries: DataFrame) -> DataFrame:
    """(input_id, record_no, ord, kind, value): the DOI of a record or else its address, then it as a reference; skipped ones with their problem."""
    title = F.when(F.col("title").endswith("."), F.col("title")).otherwise(F.concat("title", F.lit(".")))
    said = F.nullif(F.concat_ws(" ", F.when(F.size("authors") > 0, F.array_join("authors", ", ")), F.concat(F.lit("("), F.col("year"), F.lit(")")), title), F.lit(""))
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    address = F.when(F.col("doi").isNotNull(), item("doi", F.col("doi"))).when(F.col("url").isNotNull(), item("url", F.col("url")))
    both = F.filter(F.array(address, F.when(said.isNotNull(), item("reference", said))), lambda x: x.isNotNull())
    each = F.when(F.col("problem").isNotNull(), F.array(item("skipped", F.col("problem")))).otherwise(both)
    return entries.select("input_id", "record_no", F.posexplode(each).alias("no", "x")).select("input_id", "record_no", (F.col("no") + 1).alias("ord"), "x.kind", "x.value")


BIBTEX = "input_id bigint, entry_no int, entry_type string, key string, title string, authors string, year int, doi string, reference string, problem string"


def bibtex_entries(texts: DataFrame) -> DataFrame:
    """(input_id, entry_no, entry_type, key, title, authors, year, doi, reference, problem) of (input_id, text).

    Every segment that begins like an entry gives a row, broken and unsupported ones only with their
    problem; comment, preamble and string blocks give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BIBTEX.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch["input_id"], batch["text"], strict=True):
                for n, (a, b) in enumerate(bibtex_spans(text), 1):
                    entry = bibtex_entry(text[a:b])
                    if isinstance(entry, str):
                        rows.append((i, n, *[None] * 7, entry))
                    elif entry is not None:
                        title = entry.fields.get("title") or None
                        rows.append((i, n, entry.entry_type, entry.key, title, entry.authors or None, entry.year, entry.doi, reference_value(entry.authors, entry.year, title), None))
            yield pd.DataFrame(rows, columns=names).astype({"year": "Int32"})

    return texts.select("input_id", "text").filter("text IS NOT NULL").mapInPandas(run, BIBTEX)


def markdown_links(texts: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """(ord, url) of the addresses in (doc_id, text), in order of first sight; closing punctuation cut."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))
    rows = texts.select("doc_id", F.posexplode(found).alias("no", "url"))
    if not keep_duplicates:
        rows = rows.groupBy("url").agg(F.min(F.struct("doc_id", "no")).alias("_f")).select(F.col("_f.doc_id").alias("doc_id"), F.col("_f.no").alias("no"), "url")
    return rows
