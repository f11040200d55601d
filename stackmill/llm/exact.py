"""Records that differ only in formatting: one row per record and the number of its copies (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.plans.skew import attach
from stackmill.session import cut

# Fixed value: what may stand before a DOI without being part of it; group 2 is kept.
DOI_LABEL = r"(info\s*:\s*doi\s*/|\bdoi\b[\s:]*|https?://(?:dx\.)?doi\.org/)+([^a-z0-9]*10\.[0-9]{4,9})"
FIELDS = ("url", "meta_doi", "original_input")


def canonical_value(value: Column) -> Column:
    """Lower-case words of a value in sorted order; null stays null.

    Percent-encoding is decoded (a stray per cent sign is kept), a label before a DOI dropped, and
    everything that is neither letter, mark nor digit only separates words. A value without any
    word becomes the empty string, which equals other such values but not null.
    """
    escaped = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(escaped, r"\+", "%2B")), value))
    unlabelled = F.regexp_replace(decoded, DOI_LABEL, " $2")
    words = F.split(F.trim(F.regexp_replace(unlabelled, r"[^\p{L}\p{M}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def fingerprinted(df: DataFrame, id_column: str = "id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(id, form, proof): a 128-bit hash of the canonical record and an independent 64-bit one.

    Fields are joined with their place and a mark for null, so that null agrees only with null.
    """
    canon = [canonical_value(F.col(f"`{f}`").cast("string")) for f in fields]
    record = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c), F.lit("0")) for c in canon))
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.unhex(F.md5(F.encode(record, "UTF-8"))).alias("form"), F.xxhash64(F.lit(len(fields)), record).alias("proof"))


def copy_groups(keyed: DataFrame) -> DataFrame:
    """(form, proof, first_id, copies): one row per record, counted with map-side combining.

    Rows whose 128-bit hashes collide while their texts differ have different proofs and stay apart;
    ``collisions`` lists them. Rows count as copies whatever their id; rows without an id count too.
    """
    return keyed.groupBy("form", "proof").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """128-bit hashes that more than one canonical record has."""
    return groups.groupBy("form").agg(F.count("*").alias("records")).filter("records > 1")


def copies(keyed: DataFrame) -> DataFrame:
    """(first_id, copy_id): one row per copy beside the first of its set.

    Rows that repeat an id are one copy; rows without an id are none. Sets of one id give no row; an empty table gives none.
    """
    keyed = cut(keyed.filter("id IS NOT NULL").distinct())
    sets = copy_groups(keyed).filter("copies > 1")
    return attach(keyed, sets, ["form", "proof"], "copies").filter("id != first_id").select("first_id", F.col("id").alias("copy_id"))
