"""Named queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm import exact, lookalike, matching, mixing, names, packing, quality, survivor, tokens
from stackmill.operators.packed_values import packed_fields, unpack
from stackmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_entities(
        [
            matching.source(table(spark, folder, "queue_metadata"), 0, "meta_id", "authors", "dedup_key"),
            matching.source(table(spark, folder, "bibtex_entries"), 1, "bib_id", "author"),
            matching.source(table(spark, folder, "ris_entries"), 2, "ris_id", "authors"),
        ]
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of two tables that describe one work."""
    return matching.same_works(_matches(spark, folder))


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs with their marginal match probability."""
    return _matches(spark, folder)


def _survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.survivors(table(spark, folder, "queue_metadata"), table(spark, folder, "resolvers"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Per key of several captures and field: the capture with the best value, if one is best."""
    return survivor.clear_winners(_survivors(spark, folder))


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One record per key with title, authors and year and where each comes from."""
    return _survivors(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of a request beside the first of their set."""
    return exact.copies(exact.fingerprinted(table(spark, folder, "queue_items")))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per request and the number of rows that say it."""
    return exact.copy_groups(exact.fingerprinted(table(spark, folder, "queue_items"))).select("first_id", "copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Author names linked to the reference entry they mean."""
    fields = packed_fields(table(spark, folder, "queue_metadata"), "meta_id", "authors").unionByName(packed_fields(table(spark, folder, "bibtex_entries"), "bib_id", "author"))
    packed = unpack(fields).withColumnRenamed("value", "name")
    parts = table(spark, folder, "crossref_authors").select(F.col("row_id").cast("bigint").alias("record_id"), F.col("seq").cast("int").alias("pos"), F.concat_ws(", ", "family", "given").alias("name"))
    return names.link_names(packed.unionByName(parts), table(spark, folder, "authority_names"))


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.titled(table(spark, folder, "queue_metadata"), "meta_id").unionByName(lookalike.titled(table(spark, folder, "bibtex_entries"), "bib_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose titles look the same and are different strings."""
    return lookalike.lookalike_pairs(_titles(spark, folder))


def p7_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Every title in its one form."""
    return lookalike.canonical_titles(_titles(spark, folder))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.sized(table(spark, folder, "documents")), table(spark, folder, "pack_specs"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, per capacity."""
    return _packed(spark, folder)


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, least possible and room left, per capacity."""
    return packing.filling(_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(tokens.sized(table(spark, folder, "documents"), None, "source"), table(spark, folder, "mix_targets"))


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix in order of their finish time."""
    return _mixed(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share every source reached in each mix."""
    return mixing.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are no natural prose."""
    return quality.unnatural(quality.quality(table(spark, folder, "documents")))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, distance from prose and its parts for every document."""
    return quality.quality(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p3_survivors, p4_found, p4_records, p5_found, p7_found, p7_titles, p8_packed, p8_filling, p9_mixed, p9_shares, p10_found, p10_statistics)}


def _canonical_sql(column: str) -> str:
    label = r"(info\s*:\s*doi\s*/|\bdoi\b[\s:]*|https?://(?:dx\.)?doi\.org/)+([^a-z0-9]*10\.[0-9]{4,9})"
    decoded = f"lower(url_decode({column}))"
    words = rf"trim(regexp_replace(regexp_replace({decoded}, '{label}', ' \2', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
    return f"coalesce('=' || array_to_string(list_sort(string_split({words}, ' ')), ' '), '0')"


_FORMS = f"SELECT id, concat_ws(chr(31), {', '.join(_canonical_sql(c) for c in exact.FIELDS)}) AS form FROM queue_items"

ORACLE_SQL: dict[str, str] = {
    "p4_records": f"SELECT min(id) AS first_id, count(*) AS copies FROM ({_FORMS}) GROUP BY form",
    "p4_found": f"WITH f AS (SELECT DISTINCT id, form FROM ({_FORMS})), g AS (SELECT form, min(id) AS first_id FROM f GROUP BY form) SELECT first_id, id AS copy_id FROM f JOIN g USING (form) WHERE id <> first_id",
}
