"""Queries of the general data-preparation operators (problems 1 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.operators.packed_values import packed_fields, unpack
from stackmill.operators.raw_records import load_raw_records, loaded_entries, rejected_records
from stackmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The raw records that fail."""
    return rejected_records(load_raw_records(table(spark, folder, "raw_records"))).select("record_id")


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The valid raw records as entries."""
    return loaded_entries(load_raw_records(table(spark, folder, "raw_records")))


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The failing raw records with their reasons."""
    return rejected_records(load_raw_records(table(spark, folder, "raw_records")))


def _authors(spark: SparkSession, folder: str) -> DataFrame:
    return packed_fields(table(spark, folder, "queue_metadata"), "meta_id", "authors").unionByName(packed_fields(table(spark, folder, "ris_entries"), "ris_id", "authors"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The names of author fields that hold two or more."""
    return unpack(_authors(spark, folder), least=2).select("record_id", "pos", F.col("value").alias("author"))


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """The names of all author fields."""
    return unpack(_authors(spark, folder)).select("record_id", "pos", F.col("value").alias("author"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_entries, p1_rejects, p6_found, p6_values)}
