"""Order-dependent computations over a whole table without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.session import cut


def with_next(df: DataFrame, key: str, value: str, out: str = "next") -> DataFrame:
    """``df`` with the value that follows in (key, value) order within the key; null after the last.

    The rows are range-partitioned on both columns, so a key that holds most of the table lies on
    many tasks. Within a task a window looks ahead; across the seams each key's first value of
    every partition is used, at most one row per key and partition.
    """
    ranged = cut(df.repartitionByRange(F.col(key), F.col(value)).withColumn("_part", F.spark_partition_id()))
    here = ranged.withColumn("_ahead", F.lead(value).over(Window.partitionBy("_part", key).orderBy(value)))
    firsts = ranged.groupBy(key, "_part").agg(F.min(value).alias("_first"))
    seams = firsts.withColumn("_seam", F.lead("_first").over(Window.partitionBy(key).orderBy("_part"))).filter("_seam IS NOT NULL").drop("_first")
    return here.join(seams, [key, "_part"], "left").withColumn(out, F.coalesce("_ahead", "_seam")).drop("_part", "_ahead", "_seam")


def numbered(df: DataFrame, keys: list[str], order: str, out: str, bucket: int = 100_000) -> DataFrame:
    """``df`` with the place of each row within its keys by an integer column, counted from 0.

    Rows are numbered within ranges of ``order`` and offset by the counts of the ranges before, so a
    key of many rows is spread over its ranges.
    """
    split = df.withColumn("_range", F.floor(F.col(order) / bucket))
    counts = split.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    return split.withColumn("_local", local).join(offsets, [*keys, "_range"]).withColumn(out, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")


def numbered_table(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with the place of each row in the order of one column, counted from 0.

    Rows are ranged over all tasks, numbered within them and offset by the counts of the ranges
    before, one number per task.
    """
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def unique_names(df: DataFrame, within: str, name: str, order: str, out: str = "unique_name", start: int = 1) -> DataFrame:
    """``df`` with names that occur once within ``within``: the first row of a name keeps it, later ones get ``_1``, ``_2``, ...

    A made name never takes one that is given: numbers that lead to a given name are passed over, so
    the k-th repeat gets the k-th free number. Given names of the form ``stem_number`` are looked up
    by their stem and number, nothing is tried one by one.
    """
    stem, ending = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    named = numbered(df, [within, name], order, "_n").withColumn("_stem", stem).withColumn("_end", ending)
    given = named.filter("_n = 0").select(within, "_end", F.regexp_extract("_stem", r"(?s)^(.*)_([1-9][0-9]{0,8})$", 1).alias("_stem"), F.regexp_extract("_stem", r"(?s)^(.*)_([1-9][0-9]{0,8})$", 2).try_cast("int").alias("_no")).filter("_no IS NOT NULL")
    # Only names that repeat can lead to a given one, and only numbers up to their repeats and those passed over.
    repeats = named.filter("_n > 0").groupBy(within, "_stem", "_end").agg(F.max("_n").alias("_most"))
    used = given.filter(F.col("_no") >= start).join(repeats, [within, "_stem", "_end"], "left_semi").groupBy(within, "_stem", "_end").agg(F.array_sort(F.collect_set("_no")).alias("_used"))
    met = named.join(used, [within, "_stem", "_end"], "left")
    # The k-th free number: every used one at or below it moves it on.
    number = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), (F.col("_n") + start - 1).cast("int"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    made = F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), number, "_end"))
    return met.withColumn(out, made).drop("_n", "_stem", "_end", "_used")
