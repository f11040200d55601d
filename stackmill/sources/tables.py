"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; times without zone become UTC timestamps, so that streams and epochs accept them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in plain}) if plain else df
