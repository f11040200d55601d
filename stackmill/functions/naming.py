"""File names, project names, citation keys and cell texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackmill.functions.urls import domain, extension

# Reserved device names and limits.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
TITLE_CHARS, FOLDER_CHARS, MOST_SEGMENTS = 60, 80, 10


def filename_component(value: Column) -> Column:
    """Letters, digits, dots and hyphens; every run of anything else becomes one underscore."""
    return F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}.\-]+", "_"), F.lit("_"))


def primary_author(authors: Column) -> Column:
    """Family part of the first of several authors, fit for a file name."""
    first = F.trim(F.split_part(authors, F.lit(";"), F.lit(1)))
    family = F.coalesce(F.nullif(F.trim(F.split_part(first, F.lit(","), F.lit(1))), F.lit("")), first)
    return F.nullif(filename_component(family), F.lit(""))


def preferred_filename(url: Column, authors: Column, year: Column, title: Column, epoch: Column) -> Column:
    """``Author_Year_Title.ext`` where all three are known, else ``domain_epoch.ext``."""
    ending = F.coalesce(extension(url), F.lit(".bin"))
    year_part, title_part = F.nullif(filename_component(year), F.lit("")), F.nullif(filename_component(title), F.lit(""))
    named = F.concat(primary_author(authors), F.lit("_"), year_part, F.lit("_"), F.left(title_part, F.lit(TITLE_CHARS)), ending)
    return F.coalesce(named, F.concat(filename_component(F.replace(domain(url), F.lit("."), F.lit("-"))), F.lit("_"), epoch.cast("string"), ending))


def project_name(value: Column) -> Column:
    """A project name with white space, control and path characters folded to single hyphens."""
    return F.trim(F.regexp_replace(F.trim(value), r"[/\\:*?\"<>|\s\p{Cc}-]+", "-"), F.lit("-"))


def project_segment(value: Column) -> Column:
    """A folder name for one segment; null for empty, ``.`` and ``..``."""
    plain = F.trim(project_name(value), F.lit("."))
    named = F.when(F.upper(plain).isin(RESERVED), F.concat(plain, F.lit("-project"))).otherwise(plain)
    short = F.when(F.length(named) > FOLDER_CHARS, F.trim(F.left(named, F.lit(FOLDER_CHARS)), F.lit("-"))).otherwise(named)
    return F.when(F.trim(value).isin("", ".", ".."), None).otherwise(F.nullif(short, F.lit("")))


def project_folder(value: Column) -> Column:
    """Relative folder of a project path; null when a segment is not allowed or there are too many."""
    segments = F.split(F.replace(F.trim(value), F.lit("\\"), F.lit("/")), "/")
    clean = F.transform(segments, project_segment)
    return F.when((F.size(segments) <= MOST_SEGMENTS) & F.forall(clean, lambda s: s.isNotNull()), F.array_join(clean, "/"))


def truncated(value: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis when cut."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 1)), F.lit("…"))).otherwise(value)


def markdown_cell(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("\\`"))
    return F.translate(escaped, "\n\r", "  ")


def bibtex_escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"([&%$#])", r"\\$1")


def date_year(date: Column) -> Column:
    """Four digits before the first hyphen; null otherwise."""
    head = F.trim(F.split_part(date, F.lit("-"), F.lit(1)))
    return F.when(head.rlike(r"^[0-9]{4}$"), head)


def last_name(name: Column) -> Column:
    """Lower-case text before a comma, or the last word."""
    words = F.split(F.trim(name), r"\s+")
    return F.lower(F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(F.trim(name), F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1)))


def citation_key(first_author: Column, date: Column, fallback: Column) -> Column:
    """Last name and year, whichever exist, else the fallback; ASCII letters, digits, hyphen, underscore."""
    joined = F.concat(F.coalesce(last_name(first_author), F.lit("")), F.coalesce(date_year(date), F.lit("")))
    return F.lower(F.regexp_replace(F.coalesce(F.nullif(joined, F.lit("")), fallback), r"[^A-Za-z0-9_\-]", ""))


def sidecar_authors(authors: Column) -> Column:
    """Authors at semicolons; else at commas when every part has two words; else one author."""
    parts = lambda pattern: F.filter(F.transform(F.split(authors, pattern), lambda p: F.trim(p)), lambda p: p != "")
    commas = parts(",")
    full = (F.size(commas) > 1) & F.forall(commas, lambda p: F.size(F.split(p, r"\s+")) >= 2)
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.trim(authors), F.lit("")) == "", none).when(F.contains(authors, F.lit(";")), parts(";")).when(full, commas).otherwise(F.array(F.trim(authors)))
