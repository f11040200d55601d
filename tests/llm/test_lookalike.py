"""Problem 7: one form for text that looks the same."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from stackmill.llm import lookalike


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"),
        ("café", "café"),
        ("ﬁeld ﬂow", "field flow"),
        ("zero​width﻿ soft­hyphen", "zerowidth softhyphen"),
        ("no break thin", "no break thin"),
        ("Саfе Οmega", "Cafe Omega"),
        ("e​́", "é"),
        ("40 µm", "40 μm"),
        ("각", "각"),
    ],
)
def test_equal_looks(a, b):
    assert lookalike.canonical(a) == lookalike.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("resume", "résumé"), ("a-b", "a b"), ("Title", "title"), ("x²", "x2"), ("cut…", "cut..."), ("½", "1⁄2"), ("a  b", "a b")])
def test_visible_differences_stay(a, b):
    assert lookalike.canonical(a) != lookalike.canonical(b)


def test_segments_equal_whole_string_and_are_stable():
    rng = random.Random(3)
    pool = "aeioAE ẹ́̈ǖ각각ﬁＡ​ Аоμ1-…\U0001d400ힰ"
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        form = lookalike.canonical(text)
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(lookalike._fold())).translate(lookalike._fold()))
        assert form == whole and lookalike.canonical(form) == form


def test_pairs_equal_brute_force_and_edges(spark):
    titles = ["Editorial", "Еditorial", "Edito​rial", None, "", "​", " ", "x" * 50_000, "х" + "x" * 49_999, "Solo", "solo"]
    rows = [(i, t) for i, t in enumerate(titles * 2)] + [(0, "Editorial"), (None, "Editorial")]
    df = spark.createDataFrame(rows, "id long, title string").withColumn("form", F.lit("clash")).withColumn("record_id", F.lit(1))
    got = sorted(tuple(r) for r in lookalike.lookalike_pairs(lookalike.titled(df, "id")).collect())
    known = {i: t for i, t in rows if t is not None and i is not None}
    want = sorted((a, b) for a in known for b in known if a < b and known[a] != known[b] and lookalike.canonical(known[a]) == lookalike.canonical(known[b]))
    assert got == want and len(got) > 10
    assert lookalike.lookalike_pairs(lookalike.titled(df.limit(0), "id")).count() == 0


def test_frequent_strings_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "SALT_ROWS", 7)
    rows = [(i, ("Editorial", "Еditorial", "Edito\u200brial")[i % 3]) for i in range(90)] + [(0, "Еditorial"), (500, "Solo")]
    df = spark.createDataFrame(rows, "id long, title string")
    found = [tuple(r) for r in lookalike.lookalike_pairs(lookalike.titled(df, "id")).collect()]
    want = {(min(a, b), max(a, b)) for a, s in rows for b, t in rows if a != b and s != t and "Solo" not in (s, t)}
    assert sorted(found) == sorted(want)


def test_column_form(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "Ｗ"), (3, None), (4, "")], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(lookalike.canonical_text(F.col("t"))).collect()] == ["plain", "W", None, ""]
