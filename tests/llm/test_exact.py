"""Problem 4: records that differ only in formatting."""

import pytest
from pyspark.sql import functions as F

from stackmill.llm import exact


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://H.org/a%2Cb/?x=1&y=2", "HTTPS://h.org//A,b?y=2&x=1 ", True),
        ("doi: 10.1234/AB(1)", "10.1234/ab(1)", True),
        ("info:doi/10.1234/x", "https://doi.org/10.1234/x", True),
        ("Smith J (2001). A b. C.", "c; [2001] | SMITH J | a, b", True),
        ("10.1234/x?copy=3", "10.1234/x", False),
        ("10.1234/x1", "10.1234/x 1", False),
        ("a 100% b", "a 100 b", True),
        ("a+b", "a b", True),
        ("", "...", True),
        (None, "", False),
        ("é", "e", False),
    ],
)
def test_forms(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(exact.canonical_value(F.col("a")).alias("a"), exact.canonical_value(F.col("b")).alias("b")).first()
    assert (row["a"] == row["b"]) is same


def test_groups_copies_and_edges(spark):
    rows = [(i, "https://x.org/hot", None, None, i) for i in range(1, 301)] + [(1, "https://x.org/hot", None, None, 0), (400, "u", None, "w"), (401, "U ", None, "W."), (402, "u", "", "w"), (None, "u", None, "w"), (500, "y" * 200_000, None, None)]
    rows = [(*r, 0)[:5] for r in rows]
    df = spark.createDataFrame(rows, "id long, url string, meta_doi string, original_input string, copies long").withColumn("form", F.lit("clash"))
    keyed = exact.fingerprinted(df)
    groups = {r["first_id"]: r["copies"] for r in exact.copy_groups(keyed).collect()}
    assert groups == {1: 301, 400: 3, 402: 1, 500: 1}
    found = sorted(tuple(r) for r in exact.copies(keyed).collect())
    assert found == [(1, i) for i in range(2, 301)] + [(400, 401)]
    assert exact.collisions(exact.copy_groups(keyed)).count() == 0 and exact.copies(keyed.limit(0)).count() == 0


def test_colliding_hashes_stay_apart(spark):
    keyed = spark.createDataFrame([(1, b"same", 1), (2, b"same", 2), (3, b"same", 1)], "id long, form binary, proof long")
    groups = exact.copy_groups(keyed)
    assert exact.collisions(groups).count() == 1 and sorted(tuple(r) for r in exact.copies(keyed).collect()) == [(1, 3)]
