"""What the queries read: tables of a folder in the form the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions.naming import sidecar_authors
from stackmill.operators import history
from stackmill.sources.tables import table

STATUSES = ["pending", "in_progress", "completed", "failed"]


def attempts(spark: SparkSession, folder: str, condition: str | None = None) -> DataFrame:
    """The attempts, one row each; the condition is on what an attempt says, so it is checked at the scan."""
    log = deliveries(spark, folder)
    return history.current_attempts(log if condition is None else log.filter(condition))


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The history as delivered, some attempts more than once."""
    return table(spark, folder, "download_log")


def queue_items(spark: SparkSession, folder: str) -> DataFrame:
    """The queue with unknown status values read as pending."""
    items = table(spark, folder, "queue_items")
    return items.withColumn("status", F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("pending"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Works as sidecar entries (path, title, authors, date, doi, url)."""
    meta = table(spark, folder, "queue_metadata")
    return meta.select(F.concat(F.lit("c/"), F.lpad(F.col("meta_id").cast("string"), 9, "0"), F.lit(".json")).alias("path"), "title", sidecar_authors(F.col("authors")).alias("authors"), F.col("year").alias("date"), "doi", F.lit(None).cast("string").alias("url"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages rendered from records: title with references, citation tags in either attribute order."""
    tag = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value, F.lit('">\n'))
    title = F.coalesce(F.col("title"), F.lit(""))
    for char, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\u2013", "&ndash;"), ("\u2014", "&#8212;"), ("\u00a0", "&nbsp;")):
        title = F.replace(title, F.lit(char), F.lit(name))
    html = F.concat(F.lit("<html><head><title> "), title, F.lit(" </title>\n<meta charset='utf-8'>"), tag("citation_title", title), F.lit("<meta content='"), F.coalesce("doi", F.lit("none")), F.lit("' name='citation_doi'>"), tag("citation_author", F.col("key")), tag("citation_author", F.col("key")), tag("citation_author", F.col("entry_type")), tag("citation_publication_date", F.coalesce(F.concat("year", F.lit("/05/01")), F.lit("n.d."))), F.lit("</head><body><a href=\"/files/"), F.col("bib_id"), F.lit('.pdf">x</a></body></html>'))
    return table(spark, folder, "bibtex_entries").select("bib_id", html.alias("html"))
