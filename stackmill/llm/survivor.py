"""The surviving record of each group of captures, field by field (problem 3).

Each field is decided by one aggregation that takes the maximum of a composite struct (whole, trust,
time, value); partial maxima are combined before the shuffle, so a key that holds a third of all
rows costs no more than others. Titles are first folded to one row per distinct form, whose
prefixes are found in sorted order across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.llm.lookalike import canonical_text
from stackmill.llm.names import unaccented
from stackmill.operators.packed_values import LEFT_OUT, Codes, dialect_codes, values_count
from stackmill.plans.ordered import with_next
from stackmill.session import cut

# What stands for a missing value, and the marks of a text that was cut short.
MISSING = ["", "-", "--", "?", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "unknown", "unknown title", "untitled", "no title", "title not available", "not available", "tbd", "tba", "n.n.", "nn", "unknown author", "unknown authors", "anonymous", "anon", "authors missing", "author missing", "no author", "title missing", "missing", "n.d.", "nd"]
CUT_MARK = r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\((?:cont\.?|contd\.?|continued)\)|\[(?:cont\.?|continued|truncated)\])\s*$"
YEAR = r"(?<![0-9A-Za-z])(?:1[89][0-9]{2}|20[0-9]{2})(?![0-9A-Za-z])"
COMPACT_DATE = r"^\s*((?:1[89]|20)[0-9]{2})(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])\s*$"
FIELDS = ["title", "authors", "year"]


def _missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(F.regexp_replace(value, r"^[\s\[(]+|[\s\])]+$", ""))).isin(MISSING)


def _years(value: Column) -> Column:
    return F.array_distinct(F.when(value.rlike(COMPACT_DATE), F.array(F.regexp_extract(value, COMPACT_DATE, 1))).otherwise(F.regexp_extract_all(value, F.lit(YEAR), F.lit(0))))


def captures(df: DataFrame, resolvers: DataFrame, codes: Codes | None = None) -> DataFrame:
    """The captures with a key, reduced to what decides: trust, time, and each value's wholeness."""
    codes = dialect_codes(df.select(F.col("authors").alias("text"))) if codes is None else codes
    trust = resolvers.groupBy("resolver").agg(F.max("trust").alias("trust"))
    base = df.select("meta_id", "dedup_key", "resolver", "title", "authors", "year", "resolved_at").filter("dedup_key IS NOT NULL")
    base = base.join(trust, "resolver", "left")
    marked_authors = F.coalesce(F.col("authors").rlike(f"(?i){LEFT_OUT}"), F.lit(False))
    form = F.regexp_replace(F.trim(unaccented(canonical_text(F.col("title")))), r"[\s.,;:!?-]+$", "")
    return base.select(
        "dedup_key",
        "title",
        "authors",
        "year",
        F.struct(F.coalesce("trust", F.lit(-1)).alias("trust"), F.coalesce(F.unix_micros(F.col("resolved_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), (-F.col("meta_id")).alias("low")).alias("rank"),
        form.alias("form"),
        (~_missing(F.col("title"))).alias("has_title"),
        (~_missing(F.col("title")) & ~F.col("title").rlike(CUT_MARK)).alias("whole_title"),
        F.when(~_missing(F.col("authors")), values_count(F.col("authors"), codes)).otherwise(0).alias("listed"),
        (~_missing(F.col("authors")) & ~marked_authors).alias("whole_authors"),
        (F.coalesce(F.size(_years(F.col("year"))), F.lit(0)) == 1).alias("whole_year"),
    )


def best_values(held: DataFrame) -> DataFrame:
    """One row per key: rows, and per field the best whole value by (trust, time) with its source.

    ``<field>_id`` is the capture the value comes from and ``<field>_clear`` says that no other whole
    value is of later time, that is, that the capture is best in trust and in time. Exact ties go to
    the smallest id. A field without a whole value is null. Rows without a key are in no group, a
    missing time is the earliest, an unknown resolver has the least trust.
    """
    held = cut(held)
    ranked = lambda value: F.struct("rank.trust", "rank.at", "rank.low", F.col(value).alias("value"))
    forms = held.filter("has_title").groupBy("dedup_key", "form").agg(F.max(F.when(F.col("whole_title"), ranked("title"))).alias("top"), F.max(F.when(F.col("whole_title"), F.col("rank.at"))).alias("latest"))
    uncut = with_next(forms, "dedup_key", "form").filter("top IS NOT NULL AND NOT coalesce(startswith(next, form), false)")
    titles = uncut.groupBy("dedup_key").agg(F.max("top").alias("t"), F.max("latest").alias("t_at"))
    rest = held.groupBy("dedup_key").agg(
        F.count("*").alias("captures"),
        F.max("listed").alias("most"),
        F.max(F.when(F.col("whole_authors"), F.struct("listed", "rank.trust", "rank.at", "rank.low", F.col("authors").alias("value")))).alias("a"),
        F.max(F.when(F.col("whole_authors"), F.struct("listed", F.col("rank.at").alias("at")))).alias("a_at"),
        F.max(F.when(F.col("whole_year"), ranked("year"))).alias("y"),
        F.max(F.when(F.col("whole_year"), F.col("rank.at"))).alias("y_at"),
    )
    whole_authors = F.col("a.listed") == F.col("most")
    return rest.join(titles, "dedup_key", "left").select(
        "dedup_key",
        "captures",
        F.col("t.value").alias("title"),
        (-F.col("t.low")).alias("title_id"),
        (F.col("t.at") == F.col("t_at")).alias("title_clear"),
        F.when(whole_authors, F.col("a.value")).alias("authors"),
        F.when(whole_authors, -F.col("a.low")).alias("authors_id"),
        F.when(whole_authors, F.col("a.at") == F.col("a_at.at")).alias("authors_clear"),
        F.col("y.value").alias("year"),
        (-F.col("y.low")).alias("year_id"),
        (F.col("y.at") == F.col("y_at")).alias("year_clear"),
    )


def survivors(df: DataFrame, resolvers: DataFrame, codes: Codes | None = None) -> DataFrame:
    """One record per key; see ``best_values``. Only the named columns of the inputs are read."""
    return best_values(captures(df, resolvers, codes))


def clear_winners(best: DataFrame) -> DataFrame:
    """(dedup_key, field_name, meta_id) of groups of two or more whose capture is best in trust and time."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_id").alias("meta_id"), F.col(f"{f}_clear").alias("clear")) for f in FIELDS])
    return best.filter("captures >= 2").select("dedup_key", F.inline(each)).filter("clear").select("dedup_key", "field_name", "meta_id")
