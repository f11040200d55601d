"""Bibliography exports, sidecar documents and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions import failures
from stackmill.functions.identifiers import stripped
from stackmill.functions.naming import bibtex_escaped, citation_key, date_year, markdown_cell, sidecar_authors, truncated
from stackmill.functions.urls import host, host_within
from stackmill.operators.queue import newly_completed
from stackmill.operators.topics import normal_topics, stored_topics


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {name:<9} = {{"), value, F.lit("}"))


def bibtex_entries(corpus: DataFrame) -> DataFrame:
    """Adds ``entry``: an @article of (path, title, authors, date, doi, url); missing fields are left out."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    key = citation_key(F.try_element_at("authors", F.lit(1)), F.col("date"), stem)
    authors = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", bibtex_escaped), " and "))
    fields = F.concat_ws(",\n", _field("title", bibtex_escaped(F.col("title"))), _field("author", authors), _field("year", date_year(F.col("date"))), _field("doi", bibtex_escaped(F.col("doi"))), _field("url", bibtex_escaped(F.col("url"))))
    return corpus.withColumn("entry", F.concat(F.lit("@article{"), key, F.lit(",\n"), fields, F.when(fields != "", "\n").otherwise(""), F.lit("}")))


def ris_records(corpus: DataFrame) -> DataFrame:
    """Adds ``entry``: a RIS record of the same columns."""
    line = lambda tag, value: F.concat(F.lit(f"{tag}  - "), value)
    authors = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: line("AU", a)), "\n"))
    return corpus.withColumn("entry", F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), authors, line("PY", date_year(F.col("date"))), line("DO", F.col("doi")), line("UR", F.col("url")), F.lit("ER  - \n")))


def document_lines(entries: DataFrame, blank: bool = True) -> DataFrame:
    """(path, no, line): the lines of a bibliography in the order of (path, no), with a blank line between entries.

    The document is never gathered in one place: ``sources.files.write_rows`` writes it part by part.
    """
    lines = F.split(F.col("entry"), "\n")
    first = entries.agg(F.min("path")).first()[0]
    after = F.when((F.col("path") > F.lit(first)) & F.lit(blank), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return entries.select("path", F.posexplode(F.concat(after, lines)).alias("no", "line"))


def exported(corpus: DataFrame, form: str) -> DataFrame:
    """(path, no, line): a corpus in one of the forms, ``bibtex`` or ``ris``; another is an error."""
    forms = {"bibtex": (bibtex_entries, True), "ris": (ris_records, False)}
    if form not in forms:
        raise ValueError(f"unknown form {form!r}: one of {', '.join(forms)}")
    make, blank = forms[form]
    return document_lines(make(corpus), blank)


def sidecar_path(saved_path: Column) -> Column:
    """The path of a file's sidecar: its extension replaced."""
    return F.concat(F.regexp_replace(saved_path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".json"))


def sidecars(queue: DataFrame) -> DataFrame:
    """(id, document): JSON-LD of the queue's completed items; null and empty values are left out."""
    some = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    people = F.transform(sidecar_authors(F.col("meta_authors")), lambda n: F.struct(F.lit("Person").alias("@type"), n.alias("name")))
    identifier = F.when(some("meta_doi").isNotNull(), F.struct(F.lit("PropertyValue").alias("@type"), F.lit("DOI").alias("propertyID"), some("meta_doi").alias("value")))
    document = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ScholarlyArticle").alias("@type"), some("meta_title").alias("name"), F.when(F.size(people) > 0, people).alias("author"), some("meta_year").alias("datePublished"), identifier.alias("identifier"), some("url").alias("url"))
    return queue.filter("status = 'completed'").select("id", F.to_json(document, {"ignoreNullFields": "true"}).alias("document"))


def sidecar_plan(queue: DataFrame, existing: DataFrame, before: DataFrame) -> DataFrame:
    """(id, path, action, document) for the items completed since ``before`` with a saved file.

    ``existing`` has (path, document). A path without a sidecar is written; a valid one is left; one
    that is no JSON is moved aside (``quarantine``) and written anew.
    """
    fresh = queue.filter("status = 'completed' AND saved_path IS NOT NULL").join(before.select("id"), "id", "left_anti")
    wanted = fresh.select("id", sidecar_path(F.col("saved_path")).alias("path")).join(sidecars(fresh), "id")
    held = existing.select("path", F.try_parse_json("document").isNotNull().alias("valid"))
    met = wanted.join(held, "path", "left")
    action = F.when(F.col("valid").isNull(), "write").when(F.col("valid"), "keep").otherwise("quarantine")
    return met.select("id", "path", action.alias("action"), F.when(action != "keep", F.col("document")).alias("document"))


SIDECAR = "struct<`@type`:string,name:string,author:array<struct<`@type`:string,name:string>>,datePublished:string,identifier:struct<propertyID:string,value:string>,url:string>"


def read_sidecars(documents: DataFrame) -> DataFrame:
    """(path, title, authors, date, doi, url) of (path, document); other types and broken JSON are left out."""
    parsed = documents.withColumn("_d", F.from_json("document", SIDECAR)).filter(F.col("_d.`@type`") == "ScholarlyArticle")
    names = F.coalesce(F.transform("_d.author", lambda a: a["name"]), F.array().cast("array<string>"))
    return parsed.select("path", F.col("_d.name").alias("title"), names.alias("authors"), F.col("_d.datePublished").alias("date"), F.col("_d.identifier.value").alias("doi"), F.col("_d.url").alias("url"))


def _file_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))


def index_rows(queue: DataFrame, *keep: str) -> DataFrame:
    """(id, row, *keep): a markdown table row per completed item: file, title, authors and address."""
    cell = lambda value, none: markdown_cell(F.coalesce(value, F.lit(none)))
    row = F.concat(F.lit("| `"), cell(_file_name(F.col("saved_path")), "unknown"), F.lit("` | "), cell(F.col("meta_title"), "n/a"), F.lit(" | "), cell(F.col("meta_authors"), "n/a"), F.lit(" | <"), markdown_cell(F.col("url")), F.lit("> |"))
    return queue.filter("status = 'completed'").select("id", row.alias("row"), *keep)


INDEX_HEAD = ["| Filename | Title | Authors | Source URL |", "| --- | --- | --- | --- |"]


def index_section(queue: DataFrame, before: DataFrame, session: Column) -> DataFrame:
    """(project, part, id, line): the lines of each project's new section, in the order of (project, part, id).

    Heading, topics, table head, then a row per item completed since ``before``. The rows of a
    project are never gathered; its distinct topics are, as they make one line.
    """
    fresh = newly_completed(queue, before).filter("project IS NOT NULL")
    none = F.lit(None).cast("bigint")
    topics = fresh.select("project", F.explode_outer(normal_topics(stored_topics(F.col("topics")))).alias("t")).distinct().groupBy("project").agg(F.array_sort(F.collect_list("t")).alias("topics"))
    said = F.concat(F.lit("**Topics detected:** "), F.size("topics"), F.lit(" | "), F.array_join("topics", ", "))
    lines = F.concat(F.array(F.concat(F.lit("## Session "), session), F.lit("")), F.when(F.size("topics") > 0, F.array(said, F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, INDEX_HEAD)))
    head = topics.select("project", F.posexplode(lines).alias("part", "line")).select("project", "part", none.alias("id"), "line")
    rows = index_rows(fresh, "project").select("project", F.lit(len(INDEX_HEAD) + 4).alias("part"), "id", F.col("row").alias("line"))
    return head.unionByName(rows)


def conversion_plan(pages: DataFrame, pdfs: DataFrame, sidecars: DataFrame, useless_hosts: list[str]) -> DataFrame:
    """Pages (id, stem) with ``action``: keep where a PDF of the stem exists, skip where a sidecar's host gives none, else convert."""
    useless = F.lit(False)
    for suffix in useless_hosts:
        useless = useless | F.coalesce(host_within(F.col("url"), suffix), F.lit(False))
    cards = sidecars.filter("stem IS NOT NULL").groupBy("stem").agg(F.bool_or(host(F.col("url")).isNotNull() & useless).alias("_useless"))
    there = pdfs.filter("stem IS NOT NULL").select("stem").distinct().withColumn("_pdf", F.lit(True))
    met = pages.join(there, "stem", "left").join(cards, "stem", "left")
    return met.withColumn("action", F.when(F.col("_pdf"), "keep").when(F.col("_useless"), "skip").otherwise("convert")).drop("_pdf", "_useless")


def log_file_name(attempts_path: Column, title: Column) -> Column:
    """What names an attempt: its file, else its title, else n/a."""
    return F.coalesce(_file_name(attempts_path), title, F.lit("n/a"))


def log_source(original_input: Column, url: Column) -> Column:
    return F.coalesce(original_input, url)


def log_rows(attempts: DataFrame, *keep: str) -> DataFrame:
    """(id, row, *keep): a log line per attempt with cut fields; a reason only for failures, its first line."""
    bar = F.lit(" | ")
    file, source = truncated(log_file_name(F.col("file_path"), F.col("title")), 48), truncated(log_source(F.col("original_input"), F.col("url")), 72)
    first_line = F.regexp_extract(F.coalesce("error_message", F.lit("unknown failure")), r"^([^\r\n]*)", 1)
    reason = F.when(F.col("status") == "failed", F.concat(F.lit(" | reason="), truncated(first_line, 96))).otherwise("")
    row = F.concat(F.lit("- "), F.col("started_at"), bar, F.upper("status"), F.lit(" | file="), file, F.lit(" | source="), source, reason, F.lit(" | ref=history#"), F.col("id"))
    return attempts.select("id", row.alias("row"), *keep)


def log_section(attempts: DataFrame, start_id: int, session: Column) -> DataFrame:
    """(project, part, id, line): the lines of each project's new section, in the order of (project, part, id).

    A heading with the number of attempts after ``start_id``, then a line for each, oldest first.
    """
    fresh = attempts.filter(F.col("id") > start_id).filter("project IS NOT NULL")
    counts = fresh.groupBy("project").agg(F.count("*").alias("n"))
    lines = F.array(F.concat(F.lit("## Session "), session, F.lit(" ("), F.col("n"), F.lit(" attempts)")), F.lit(""))
    head = counts.select("project", F.posexplode(lines).alias("part", "line")).select("project", "part", F.lit(None).cast("bigint").alias("id"), "line")
    return head.unionByName(log_rows(fresh, "project").select("project", F.lit(2).alias("part"), "id", F.col("row").alias("line")))


def session_label(moment: Column, sequence: Column) -> Column:
    """A label of a session that a file name can hold; later ones of the same second are numbered."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd_HH'h'mm'm'ss's'"), F.when(sequence > 0, F.concat(F.lit("-"), sequence)).otherwise(""))


def history_lines(attempts: DataFrame, width: int = 80, failed_only: bool = False) -> DataFrame:
    """(id, row): an attempt on one line of at most ``width`` characters; failures on request with what, why and fix on lines of their own."""
    trust = F.coalesce(F.concat(F.lit(" | confidence="), F.col("parse_confidence")), F.lit(""))
    base = F.concat(F.col("started_at"), F.lit(" | "), F.upper("status"), F.lit(" | "), log_file_name(F.col("file_path"), F.col("title")), trust, F.lit(" | "), log_source(F.col("original_input"), F.col("url")))
    line = truncated(base, width)
    if failed_only:
        error, status, message = F.col("error_type"), F.col("http_status"), F.col("error_message")
        kind, what = failures.described_class(error, message), failures.described_what(error, status, message)
        sign = F.coalesce(*[F.when(kind == k, F.lit(v[0].split()[0])) for k, v in failures.CLASSES.items()])
        more = [F.concat(F.lit("  "), sign, F.lit(" What: "), what), F.concat(F.lit("  Why: "), failures.failure_why(what)), F.concat(F.lit("  Fix: "), failures.suggestion(error, status, message))]
        line = F.when(F.col("status") == "failed", F.concat_ws("\n", line, *[truncated(m, width) for m in more])).otherwise(line)
    return attempts.select("id", line.alias("row"))


def search_lines(found: DataFrame, width: int = 80) -> DataFrame:
    """(id, row): a search result of (id, started_at, title, matched_field, file_path) on one line."""
    name = F.coalesce("title", _file_name(F.col("file_path")), F.lit("n/a"))
    line = F.concat(F.col("started_at"), F.lit(" | "), name, F.lit(" | match="), F.col("matched_field"), F.lit(" | "), F.coalesce("file_path", F.lit("n/a")))
    return found.select("id", truncated(line, width).alias("row"))


def failure_summary(messages: DataFrame, width: int = 80) -> DataFrame:
    """(place, row): the lines of a summary of failure messages by class, in the order of the classes.

    Of authentication failures the domains are named with their counts. ``messages`` has (message);
    null counts as unknown. No failures give no lines. Only counts per class and domain are gathered.
    """
    text = F.coalesce("message", F.lit("unknown"))
    each = messages.select(failures.failure_class(text).alias("category"), failures.auth_domain(text).alias("domain")).groupBy("category", "domain").agg(F.count("*").alias("n"))
    named = F.array_sort(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "n"))))
    groups = each.groupBy("category").agg(F.sum("n").alias("n"), named.alias("domains"))
    affected = F.when((F.col("category") == "auth") & (F.size("domains") > 0), F.concat(F.lit(" Affected domains: "), F.array_join(F.transform("domains", lambda d: F.concat(d["domain"], F.lit(" ("), d["n"], F.lit(")"))), ", "))).otherwise("")
    of = lambda i: F.coalesce(*[F.when(F.col("category") == k, F.lit(v[i])) for k, v in failures.CLASSES.items()])
    rank = F.coalesce(*[F.when(F.col("category") == k, F.lit(i)) for i, k in enumerate(failures.CLASSES)])
    lines = F.array(F.concat(F.lit("- "), of(0), F.lit(": "), F.col("n")), F.concat(F.lit("  What: "), of(1)), F.concat(F.lit("  Why: "), of(2), affected), F.concat(F.lit("  Fix: "), of(3)))
    body = groups.select(rank.alias("rank"), F.posexplode(lines).alias("no", "row")).select((F.col("rank") * 4 + F.col("no") + 1).cast("int").alias("place"), "row")
    head = groups.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(0).alias("place"), F.lit("Failure summary by category:").alias("row"))
    return head.unionByName(body).select("place", truncated(F.col("row"), width).alias("row"))
