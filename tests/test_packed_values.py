"""Problem 6: dialects of packed fields."""

import pytest

from stackmill.operators.packed_values import Parser, cheapest, dialect_codes, packed_fields, skeleton, unpack, values_count


@pytest.fixture(scope="module")
def codes(spark, folder):
    fields = packed_fields(spark.read.parquet(f"{folder}/ris_entries.parquet"), "ris_id", "authors").unionByName(packed_fields(spark.read.parquet(f"{folder}/queue_metadata.parquet"), "meta_id", "authors"))
    return dialect_codes(fields)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Smith, John; Doe, Ann", ["Smith, John", "Doe, Ann"]),
        ("Smithson, J., Doering, A. B.", ["Smithson, J.", "Doering, A. B."]),
        ("John Smithson, A. Doering and Rick Roemer", ["John Smithson", "A. Doering", "Rick Roemer"]),
        ('"Smithson, John","Doering, Ann"', ["Smithson, John", "Doering, Ann"]),
        ("Smithson, John, Jr.; Doering, A.", ["Smithson, John, Jr.", "Doering, A."]),
        ("J. Smithson & {Foo Institute for Bar and Baz}", ["J. Smithson", "Foo Institute for Bar and Baz"]),
        ("Foo Laboratory of Bar & Baz", ["Foo Laboratory of Bar & Baz"]),
        (" ; J. Smithson;; A. Doering; et al.", ["J. Smithson", "A. Doering"]),
        ("J. Smithson, A. Doering, et al.", ["J. Smithson", "A. Doering"]),
        ("A. Doering |J. Smithson\tR. Roemer\nK. Lang / L. Kurz", ["A. Doering", "J. Smithson", "R. Roemer", "K. Lang", "L. Kurz"]),
        ("International Society for Foo, Bar Section", ["International Society for Foo, Bar Section"]),
        ("Roemer, Rick; Smithson, U. A.", ["Roemer, Rick", "Smithson, U. A."]),
        ("Smithson, J.; Doering, A.; u. a.", ["Smithson, J.", "Doering, A."]),
        ("WHO;UNESCO;Smithson, J.", ["WHO", "UNESCO", "Smithson, J."]),
        ("A. Doering; J. Smithson, et al." + " " * 40, ["A. Doering", "J. Smithson"]),
        ("N.N.", []),
        ("  ", []),
        ("?", []),
        ('"', []),
    ],
)
def test_dialects(codes, text, names):
    assert cheapest(text, codes) == names


def test_a_skeleton_is_parsed_as_its_text(spark, folder, codes):
    fields = packed_fields(spark.read.parquet(f"{folder}/ris_entries.parquet"), "ris_id", "authors").unionByName(packed_fields(spark.read.parquet(f"{folder}/queue_metadata.parquet"), "meta_id", "authors"))
    texts = [r["text"] for r in fields.filter("text IS NOT NULL").collect()]
    parser = Parser(codes)
    for text in texts:
        assert len(skeleton(text)) > 0 or text == ""
        assert parser.values(text) == [text[a:b] for a, b, _ in parser.parse(text)]
        assert parser.count(text) == len(parser.values(text))


def test_every_delimiter_is_scored(codes):
    # Forms that the corpus holds with a delimiter inside make it cheaper not to cut.
    known = {**codes, "I W ; I W": 0.5, "I W": 20.0}
    for mark in "/|;":
        assert cheapest(f"A. Lang{mark}B. Kurz", codes) == ["A. Lang", "B. Kurz"]
        assert cheapest(f"A. Lang{mark}B. Kurz", known) == [f"A. Lang{mark}B. Kurz"]


def test_counts(spark, codes):
    df = spark.createDataFrame([("A. Lang; B. Kurz",), (None,), ("",)], "t string")
    assert [r["n"] for r in df.select(values_count(df["t"], codes).alias("n")).collect()] == [2, None, 0]


def test_edges(spark, codes):
    rows = [(1, "A. Lang; B. Kurz", "x"), (1, "A. Lang; B. Kurz", "y"), (2, None, "z"), (3, "", None), (4, "; ".join(f"A. Name{i}" for i in range(5000)), None), (None, "C. Solo", None)]
    df = spark.createDataFrame(rows, "id long, authors string, value string")
    found = unpack(packed_fields(df, "id", "authors"), codes).collect()
    assert sum(r["record_id"] == 1 for r in found) == 4 and sum(r["record_id"] == 4 for r in found) == 5000 and sum(r["record_id"] is None for r in found) == 1
    assert unpack(packed_fields(df, "id", "authors"), codes, least=2).filter("record_id IS NULL").count() == 0
    assert unpack(packed_fields(df.limit(0), "id", "authors")).count() == 0
    assert [r["pos"] for r in sorted(found, key=lambda r: r["pos"]) if r["record_id"] == 4] == list(range(1, 5001))
