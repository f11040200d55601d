"""One form for text that looks the same (problem 7).

``canonical_text`` leaves pure ASCII values to the JVM. Of the others, a compiled quick-check class
finds the unstable characters (not normalised, combining, invisible, special spaces, look-alikes);
each run of them is normalised together with the stable character before it, which is all the
context composition can reach, and spliced into the untouched text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackmill.plans.skew import attach
from stackmill.session import cut

# Letters of other scripts drawn like Latin ones, and the Latin letters they look like.
CYRILLIC_LOOKALIKES = "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝӏҮ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXGQWaesijopcyxhdqwlY"
GREEK_LOOKALIKES = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXoj"
ARMENIAN_LOOKALIKES = "ՕՍոսցհ"
ARMENIAN_LATIN = "OUnugh"
# Hyphens drawn like the ASCII one, and characters without a mark that are no format characters.
HYPHENS = "\u2010\u2011"
BLANKS_OF_NO_WIDTH = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
VARIATION_SELECTORS = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x180F)]
# Compatibility tags whose characters look like their decomposition.
FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")
KEPT_VISIBLE = "…‥ſ"


#: Blocks of letters that neither change under normalisation nor look like others; the tables skip them.
STABLE_BLOCKS = [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x18D00), (0x20000, 0x2F800), (0x30000, 0xE0000), (0xE0200, sys.maxunicode + 1)]


def _points(start: int) -> Iterator[int]:
    """Code points from ``start`` outside the stable blocks."""
    for low, high in STABLE_BLOCKS:
        yield from range(start, low)
        start = high


@lru_cache(maxsize=1)
def _fold() -> dict[int, str]:
    """Replacement of every character that has a visible twin, is a space or is invisible."""
    fold: dict[int, str] = {}
    for point in _points(0x80):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind == "Cn" or kind == "Co" or kind == "Cs":
            continue
        if kind == "Cf" or char in BLANKS_OF_NO_WIDTH:
            fold[point] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            fold[point] = " "
        elif kind == "Cc":
            fold[point] = " " if point == 0x85 else ""
        else:
            parts = unicodedata.decomposition(char)
            if parts.startswith(FOLDED_TAGS) and char not in KEPT_VISIBLE:
                flat = unicodedata.normalize("NFKC", char)
                if not flat.startswith(" "):
                    fold[point] = flat
    for point in VARIATION_SELECTORS:
        fold[point] = ""
    for char in HYPHENS:
        fold[ord(char)] = "-"
    twins = dict(zip(CYRILLIC_LOOKALIKES + GREEK_LOOKALIKES + ARMENIAN_LOOKALIKES, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN, strict=True))
    fold |= {ord(k): v for k, v in twins.items()}
    for point, flat in list(fold.items()):
        fold[point] = "".join(twins.get(c, c) for c in flat)
    for point in (9, 10, 11, 12, 13):
        fold[point] = " "
    for point in (*range(9), *range(14, 32), 127):
        fold[point] = ""
    return fold


@lru_cache(maxsize=1)
def _quick_check() -> re.Pattern[str]:
    """Runs of unstable characters, each with the one stable character before it."""
    fold = _fold()
    unstable = []
    for point in _points(0):
        char = chr(point)
        if point in fold or (point >= 0x300 and (unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char) or _composes(point))):
            unstable.append(point)
    spans: list[list[int]] = []
    for point in unstable:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(f"(?s)[^{body}]?[{body}]+")


def _composes(point: int) -> bool:
    """Starters that may join the character before them: the vowels and finals of Hangul."""
    return 0x1161 <= point <= 0x1175 or 0x11A8 <= point <= 0x11C2


def canonical(text: str) -> str:
    """The canonical form of one text: equal for texts that look the same, and stable."""
    return _quick_check().sub(lambda m: _settle(m.group()), text)


def _settle(segment: str) -> str:
    flat = segment.translate(_fold())
    composed = unicodedata.normalize("NFC", flat)
    # Composing can build a look-alike's accented twin no further: a second fold settles what it made.
    return composed if composed.isascii() else unicodedata.normalize("NFC", composed.translate(_fold()))


@F.pandas_udf(T.StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(canonical, na_action="ignore")


def canonical_text(column: Column) -> Column:
    """The canonical form of ``column``; null stays null, blank stays blank, pure ASCII never leaves the JVM."""
    plain = column.rlike(r"^[\x20-\x7e]*\z")
    return F.when(plain, column).otherwise(_canonical_udf(F.when(~plain, column)))


def titled(df: DataFrame, id_column: str, title_column: str = "title") -> DataFrame:
    """Records as (record_id, title), without null titles; other columns are not read."""
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("record_id"), F.col(f"`{title_column}`").cast("string").alias("title")).filter("title IS NOT NULL AND record_id IS NOT NULL")


def canonical_titles(records: DataFrame) -> DataFrame:
    """(record_id, title, canonical, changed) for every record with a title.

    Null titles are no rows; empty titles keep the empty form; repeated rows stay; texts of any
    length are treated whole.
    """
    return records.withColumn("canonical", canonical_text(F.col("title"))).withColumn("changed", F.col("canonical") != F.col("title"))


#: Records of one string that meet in one task at most; a string of more is spread over salts.
SALT_ROWS = 20_000


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """(left_id, right_id), left_id < right_id: records whose titles look the same and are not the same string.

    Equal strings never meet: the join runs between the distinct strings of a form, by their hashes,
    and only forms with two or more strings take part. Both sides of a pair of frequent strings are
    salted, so its records meet in blocks of SALT_ROWS by SALT_ROWS. Repeated rows of one id count
    once. A title that is null pairs with nothing; titles that are empty or blank pair like others.
    """
    hashed = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    keyed = cut(records.select("record_id", hashed(F.col("title")).alias("string"), hashed(canonical_text(F.col("title"))).alias("form")).distinct())
    mixed = keyed.groupBy("form").agg(F.count("*").alias("n"), F.min("string").alias("least"), F.max("string").alias("most")).filter("least != most").select("form", "n")
    held = cut(attach(keyed, mixed, ["form"], "n").drop("n"))
    strings = held.groupBy("form", "string").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int")
    sized = cut(attach(held, strings, ["form", "string"], "n").select("form", "string", "record_id", F.pmod(F.xxhash64("record_id"), salts).cast("int").alias("salt")))
    side = lambda x: strings.select("form", F.col("string").alias(f"{x}_string"), F.explode(F.sequence(F.lit(0), salts - 1)).alias(f"{x}_salt"))
    pairs = side("a").join(side("b"), "form").filter("a_string < b_string")
    for x in ("a", "b"):
        rows = sized.select("form", F.col("string").alias(f"{x}_string"), F.col("salt").alias(f"{x}_salt"), F.col("record_id").alias(x))
        pairs = pairs.join(rows, ["form", f"{x}_string", f"{x}_salt"])
    out = pairs.filter("a != b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
    # Only an id with several titles can give a pair twice.
    return out.distinct() if sized.groupBy("record_id").count().filter("count > 1").head(1) else out
