"""Problem 10: statistics of texts and distance from prose."""

import numpy as np
import pytest

from stackmill.llm import quality

PROSE = "The reading list was sent to the archive in the spring, and it was not clear whether the second survey would be read. Most of the people who had asked for it were away."


def test_statistics(spark):
    rows = [(1, "The cat, the hat.\nIt is 42%\n"), (2, ""), (3, None), (4, "a" * 100_000)]
    got = {r["doc_id"]: r for r in quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["words"], got[1]["line_count"], got[1]["letter_count"]) == (6, 2, 16)
    assert got[1]["mean_word_length"] == pytest.approx(16 / 6) and got[1]["line_end_share"] == 0.5 and got[1]["common_share"] == pytest.approx(4 / 6)
    assert got[1]["digit_ratio"] == pytest.approx(2 / 21) and got[1]["symbol_ratio"] == pytest.approx(1 / 21)
    for i in (2, 3):
        assert got[i]["words"] == 0 and all(got[i][c] == 0 for c in quality.STATISTICS)
    assert got[4]["mean_word_length"] == 100_000


@pytest.fixture(scope="module")
def measured(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    more = [(10**6 + i, t, "en") for i, t in enumerate([PROSE, PROSE.upper(), PROSE.lower(), PROSE.replace(" ", ""), "see item\n" * 30, "1,2,3\n4,5,6\n" * 20, PROSE + "\n" + PROSE + "\n- one\n- two", "a7Gh9/kL+2" * 60, None, ""])]
    return quality.quality(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")))


def test_kinds(measured):
    got = {r["doc_id"] - 10**6: r["natural"] for r in measured.filter("doc_id >= 1000000").collect()}
    assert [got[i] for i in range(10)] == [True, True, True, False, False, False, True, False, False, False]


def test_parts_sum_to_the_distance(measured):
    for r in measured.collect():
        assert sum(r[f"from_{c}"] for c in quality.STATISTICS) == pytest.approx(r["distance"], rel=1e-9, abs=1e-9)


def test_distance_equals_numpy(spark, folder):
    rows = quality.text_statistics(spark.read.parquet(f"{folder}/documents.parquet"))
    names = list(quality.STATISTICS)
    model = quality._model(quality._moments(rows))
    data = rows.select("doc_id", "language", *names).toPandas()
    mean, precision = (np.array(x) for x in model["en"])
    x = data[data["language"] == "en"][names].to_numpy() - mean
    want = np.einsum("ij,jk,ik->i", x, precision.reshape(len(names), -1), x)
    got = quality._distances(rows, model).filter("language = 'en'").select("doc_id", "distance").toPandas().set_index("doc_id")["distance"]
    np.testing.assert_allclose(got.loc[data[data["language"] == "en"]["doc_id"]].to_numpy(), want, rtol=1e-9)


def test_a_language_without_a_word_list_is_named_and_not_judged(spark):
    rows = [(i, PROSE + f" It was number {i}.", "en") for i in range(20)] + [(100, "Il gatto e il cane. " * 20, "it"), (101, "1,2,3\n4,5,6\n" * 20, None), (102, PROSE, " EN-gb")]
    got = {r["doc_id"]: (r["judged"], r["natural"]) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == (False, None) and got[101] == (True, False) and got[102] == (True, True) and got[3] == (True, True)


def test_small_languages_lean_on_all_without_a_step(spark):
    names, n = list(quality.STATISTICS), len(quality.STATISTICS)
    base = {None: (1000, np.ones(n), np.eye(n))}
    means = [quality._model({**base, "de": (k, np.zeros(n), np.eye(n))})["de"][0][0] for k in (0, 59, 60, 61, 10**6)]
    assert means[0] == 1.0 and means[1] > means[2] > means[3] > means[4] and means[1] - means[3] < 0.02 and means[4] < 1e-3 and len(names) == n


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
