"""Text, bibliography, markdown, page, sidecar, registry, topic and history sources, and the sinks that mirror them."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "schema_version int, project_key string, items array<struct<dedup_key:string,canonical_doi:string,canonical_url:string,relative_path:string,first_seen_at:string,last_seen_at:string>>"
REGISTRY_VERSION = 1
# The tables of a history database with their columns.
HISTORY = {
    "queue": "id bigint, url string, source_type string, original_input string, status string, priority bigint, retry_count bigint, last_error string, created_at string, updated_at string, project string, suggested_filename string, meta_title string, meta_authors string, meta_year string, meta_doi string, topics string, parse_confidence string, parse_confidence_factors string, saved_path string, bytes_downloaded bigint, content_length bigint",
    "download_log": "id bigint, url string, final_url string, status string, file_path string, file_size bigint, content_type string, started_at string, completed_at string, error_message string, error_type string, retry_count bigint, last_retry_at string, project string, original_input string, http_status bigint, duration_ms bigint, title string, authors string, doi string, topics string, parse_confidence string, parse_confidence_factors string",
}
DATABASE = "queue.db"


def whole_texts(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, text) of the files that match a glob pattern, each as one row."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def bibliography_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, fmt, text) of .bib and .ris files under a folder; other files are not read."""
    files = whole_texts(spark, folder, "*.{bib,ris,BIB,RIS}", recursive=True)
    return files.select("path", _format("path").alias("fmt"), "text")


def _format(path: str):  # noqa: ANN202
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ending == "bib", "bibtex").when(ending == "ris", "ris")


def bibliography_inputs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Named bibliography files: (path, text) of the .bib ones, to be parsed as running text, and of the .ris ones, to be read as records.

    A file of another kind is an error, as what it holds would be lost.
    """
    wrong = [p for p in paths if not p.lower().endswith((".bib", ".ris"))]
    if wrong:
        raise ValueError(f"What: unsupported bibliography file {wrong[0]}. Why: only .bib and .ris files are read. Fix: convert it, or give DOIs and addresses directly.")
    of = lambda ending: [p for p in paths if p.lower().endswith(ending)]
    read = lambda names: spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) if names else spark.createDataFrame([], "path string, text string")
    return read(of(".bib")), read(of(".ris"))


def merged_input(arguments: DataFrame, piped: DataFrame, bib_texts: DataFrame) -> DataFrame:
    """(input_id, part, text): what was typed, piped and read from .bib files, in this order; blank pipes add nothing.

    All have (input_id, ord, text). ``joined_input`` makes one text of them.
    """
    parts = [arguments.withColumn("part", F.lit(0)), piped.filter("trim(text) != ''").withColumn("part", F.lit(1)), bib_texts.withColumn("part", F.lit(2))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def joined_input(parts: DataFrame) -> DataFrame:
    """(input_id, text): the parts of each input joined by line ends, one input being what a user gave at once."""
    listed = F.array_sort(F.collect_list(F.struct("part", "ord", "text")))
    return parts.groupBy("input_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"))


def values_of_items(items: DataFrame) -> DataFrame:
    """(input_id, text): values of RIS items as inputs to be parsed anew, their kinds forgotten, as the desktop form takes them."""
    return items.filter("kind != 'skipped'").select("input_id", F.col("value").alias("text"))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the markdown files under a folder, whatever the letter case of their endings."""
    return whole_texts(spark, folder, "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[mM][dD][xX]}", recursive=True)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the pages of a folder, not of its subfolders."""
    return whole_texts(spark, folder, "*.[hH][tT][mM][lL]")


def sidecar_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, document) of the JSON files of a folder, not of its subfolders."""
    return whole_texts(spark, folder, "*.json").withColumnRenamed("text", "document")


def custom_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a file, one per line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("topic")).filter("topic != '' AND NOT startswith(topic, '#')")


def registry_snapshots(spark: SparkSession, path: str, project: str) -> DataFrame:
    """(path, usable, items): snapshots of a registry; one of another version or project, or broken, is not usable and has no items."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"struct<{REGISTRY.replace(' ', ':', 1).replace(', project_key ', ',project_key:').replace(', items ', ',items:')}>").alias("s"))
    usable = F.coalesce((F.col("s.schema_version") == REGISTRY_VERSION) & (F.col("s.project_key") == project), F.lit(False))
    return files.select("path", usable.alias("usable"), F.when(usable, F.col("s.items")).alias("items"))


def registry(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Items of a registry snapshot; another version or project, and broken files, give no rows."""
    return registry_snapshots(spark, path, project).filter("usable").select(F.inline("items"))


def registry_is_dirty(snapshots: DataFrame) -> DataFrame:
    """(dirty), one row: a snapshot was there and could not be used, so it is to be written anew."""
    return snapshots.agg(F.coalesce(F.bool_or(~F.col("usable")), F.lit(False)).alias("dirty"))


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of all ``download_log*.parquet`` under a folder with the file each comes from; ids repeat between files."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "download_log*.parquet").parquet(folder)
    return read.withColumn("source", F.col("_metadata.file_path"))


def history_database_paths(spark: SparkSession, folder: str, name: str = DATABASE) -> list[str]:
    """Paths of the history databases in hidden folders under ``folder``, sorted; folders that cannot be read are passed over.

    Hidden folders are not searched further, nor does the file source list them, so they are listed here.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(conf)
    found, open_ = set(), [path(folder)]
    while open_:
        try:
            inside = [f.getPath() for f in system.listStatus(open_.pop()) if f.isDirectory()]
        except Exception:  # noqa: BLE001 - not there or not to be read
            continue
        for at in inside:
            if at.getName().startswith("."):
                held = path(at, name)
                if system.exists(held):
                    found.add(held.toString())
            else:
                open_.append(at)
    return sorted(found)


def history_databases(spark: SparkSession, folder: str, table: str = "download_log", name: str = DATABASE) -> DataFrame:
    """(source, ...): rows of a table of every history database in a hidden folder under ``folder``.

    Each database is read whole by one task; columns it does not have are null, and a file that is
    no such database gives no rows. Ids repeat between databases; ``source`` tells them apart.
    """
    paths = history_database_paths(spark, folder, name)
    if not paths:
        return spark.createDataFrame([], f"source string, {HISTORY[table]}")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = f"source string, {HISTORY[table]}"
    columns = [c.split()[0] for c in HISTORY[table].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield _database_rows(path, bytes(content), table, columns)

    return files.mapInPandas(run, schema)


def _database_rows(path: str, content: bytes, table: str, columns: list[str]) -> pd.DataFrame:
    empty = pd.DataFrame(columns=["source", *columns], dtype=object)
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(content)
        held = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
        if not held:
            return empty
        rows = con.execute(f"SELECT {', '.join(c if c in held else f'NULL AS {c}' for c in columns)} FROM {table}").fetchall()
    except sqlite3.DatabaseError:
        return empty
    finally:
        con.close()
    found = pd.DataFrame(rows, columns=columns, dtype=object)
    found.insert(0, "source", path)
    return found


def in_memory(df: DataFrame, name: str) -> DataFrame:
    """A table that lives as long as the session, under a name SQL can use."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def project_folders(spark: SparkSession, base: str) -> list[str]:
    """Names of the folders of ``base`` that are not hidden, the last changed first; none where it does not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(base)
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return []
    found = [(f.getModificationTime(), f.getPath().getName()) for f in system.listStatus(at) if f.isDirectory()]
    return [name for _, name in sorted(found, key=lambda x: (-x[0], x[1])) if not name.startswith(".")]


def write_rows(rows: DataFrame, column: str, order: str | list[str], folder: str, separator: str = "\n") -> None:
    """One text per row in order, parts in name order; the output committer makes it all or nothing."""
    order = [order] if isinstance(order, str) else order
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").option("lineSep", separator).text(folder)


def write_registry(items: DataFrame, folder: str) -> None:
    """Registry items as JSON lines in key order."""
    items.repartitionByRange("dedup_key").sortWithinPartitions("dedup_key").write.mode("overwrite").json(folder)


def write_sidecars(plan: DataFrame, folder: str) -> None:
    """The documents of a sidecar plan that are to be written, by action, with the path each belongs to."""
    plan.filter("action != 'keep'").select("action", "path", "document").write.mode("overwrite").partitionBy("action").json(folder)


def append_log(attempts: DataFrame, folder: str) -> None:
    """New attempts to a history, by project."""
    attempts.write.mode("append").partitionBy("project").parquet(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Changes of state to the queue's log of events."""
    events.write.mode("append").parquet(folder)
