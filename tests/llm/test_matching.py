"""Problem 2: entities of several sources."""

import itertools
import math
import random

import pytest

from pyspark.sql import functions as F

from stackmill.llm import matching


def source(spark, number, rows):
    return matching.source(spark.createDataFrame(rows, "k long, title string, authors string, year string").withColumnRenamed("k", "id"), number, "id", "authors")


BASE = "Tidal seed storage in bell lofts near Torvik"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ((BASE, "Smithson, John", "2001"), (BASE.upper() + ": a field study", "J. Smithson & A. Doering", "2002"), True),
        ((BASE, "Smithson, John", "2001"), (BASE, None, None), True),
        ((BASE, "Smithson, John", "2001"), (BASE, "Anna Kurzweil", "2009"), False),
        ((BASE, "Smithson, John", "2001"), ("Reply to: " + BASE, "Smithson, John", "2002"), False),
        ((BASE + ": Part I", "Smithson, John", "2001"), (BASE + ": Part II", "Smithson, John", "2001"), False),
        ((BASE + ": Part I", "Smithson, John", "2001"), (BASE + " - part I", "J. Smithson", "2001"), True),
        ((BASE, "Smithson, John", "2001"), (BASE + " (second cohort)", "Smithson, John", "2001"), False),
        ((BASE, "Smithson, John", "2001"), (BASE + ", a follow-up", "Smithson, John", "2001"), False),
        ((BASE + ": a field study", "Smithson, John", "2001"), (BASE + ": an inventory", "Smithson, John", "2001"), False),
        ((BASE, "Smithson, John", "2001"), ("Tid\u0430l seed storage in the bell lofts near Torvik.", "Smihtson", "2001"), True),
        ((None, "Smithson, John", "2001"), (None, "Smithson, John", "2001"), False),
        (("", None, None), ("Untitled", None, None), False),
    ],
)
def test_pairs(spark, a, b, same):
    found = matching.same_works(matching.match_entities([source(spark, 0, [(1, *a)]), source(spark, 1, [(2, *b)])])).collect()
    assert [tuple(r) for r in found] == ([(1, 2)] if same else [])


def test_generic_titles_need_a_shared_name(spark):
    left = [(i, "Editorial", f"Writer{chr(97 + i // 26)}{chr(97 + i % 26)}son, A.", "2001") for i in range(80)]
    right = [(1000 + i, "Editorial", f"A. Writer{chr(97 + i // 26)}{chr(97 + i % 26)}son", None if i % 2 else "2002") for i in range(80)]
    found = matching.same_works(matching.match_entities([source(spark, 0, left), source(spark, 1, right)])).collect()
    assert sorted(tuple(r) for r in found) == [(i, 1000 + i) for i in range(80)]


def test_beliefs_equal_exact_marginals_on_a_tree(spark):
    # a1-b1, a1-b2, a2-b2, a3-b2: no cycle, so belief propagation is exact.
    theta = {(1, 11): 1.0, (1, 12): 2.0, (2, 12): 0.5, (3, 12): -1.0}
    rows = [(a, b, 0, 1, a, b, t) for (a, b), t in theta.items()]
    got = {(r["a_ent"], r["b_ent"]): r["confidence"] for r in matching.belief(spark.createDataFrame(rows, "a_id long, b_id long, a_src int, b_src int, a_ent long, b_ent long, theta double")).collect()}
    total, on = 0.0, dict.fromkeys(theta, 0.0)
    for chosen in itertools.chain.from_iterable(itertools.combinations(theta, n) for n in range(len(theta) + 1)):
        if len({a for a, _ in chosen}) == len(chosen) == len({b for _, b in chosen}):
            weight = math.exp(sum(theta[p] for p in chosen))
            total += weight
            for p in chosen:
                on[p] += weight
    for p in theta:
        assert got[p] == pytest.approx(on[p] / total, abs=0.005)


def test_edges(spark):
    rows = [(1, BASE, "Smithson", "2001"), (1, BASE, "Smithson", "2001"), (None, BASE, "Smithson", "2001"), (3, "x" * 100_000, None, None)]
    found = matching.match_entities([source(spark, 0, rows), source(spark, 1, [(2, BASE, "Smithson", "2001")])]).collect()
    assert [(r["left_id"], r["right_id"]) for r in found] == [(1, 2)]
    assert matching.match_entities([source(spark, 0, rows).limit(0), source(spark, 1, rows)]).count() == 0


def test_a_title_on_a_third_of_the_rows_keeps_its_pairs(spark):
    works = 9000
    word = lambda i: F.translate(F.substring(F.md5(i.cast("string")), 1, 12), "0123456789", "ghijklmnop")
    i = F.col("id")
    part = lambda number, first, title, year: matching.source(spark.range(first, first + works, 1, 4).select("id", title.alias("title"), word(i % works).alias("authors"), year.alias("year")), number, "id", "authors")
    hot, other, year = F.lit("Editorial"), F.concat(F.lit("tide "), word(i), F.lit(" "), word(i + 1_000_000)), (1900 + i % 90).cast("string")
    left = part(0, 0, hot, year).unionByName(part(0, 2 * works, other, year)).unionByName(part(0, 3 * works, other, year))
    # Every third year is missing, every third one off by one.
    right = part(1, works, hot, F.when(i % 3 == 0, F.lit(None)).otherwise((1900 + i % 90 + F.when(i % 3 == 1, 1).otherwise(0)).cast("string")))
    right = right.unionByName(part(1, 4 * works, other, year)).unionByName(part(1, 5 * works, other, year))
    found = matching.same_works(matching.match_entities([left, right]))
    assert found.filter(F.col("right_id") == F.col("left_id") + works).count() == works
    assert found.count() == works


def test_long_titles_form_every_pair_that_can_pass(spark):
    filler = [(100 + i, "Editorial", f"Zz{chr(97 + i // 26) * 4}{chr(97 + i % 26) * 4}", str(1900 + i)) for i in range(80)]
    left = [(1, "Editorial", None, "2001"), (2, "Editorial", "Smithson, J.", "2003"), (3, "Editorial", "Kurzweilander", "2005"), (4, "Editorial", "WHO", "2007")]
    right = [(11, "Editorial", "Doering, A.", "2001"), (12, "Editorial", "Smihtson", "2003"), (13, "Editorial", "Kurtzveilandr", None), (14, "Editorial", "World Health Organisation", "2007"), (15, "Editorial", "Nobody Else", "2010")]
    found = matching.same_works(matching.match_entities([source(spark, 0, left + filler), source(spark, 1, right)])).collect()
    assert sorted(tuple(r) for r in found) == [(1, 11), (2, 12), (3, 13), (4, 14)]


def test_slips_equal_brute_force(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(4, 12))) for _ in range(120)})
    words = sorted({*words, *[w[: (i := draw.randrange(len(w)))] + draw.choice("abc") + w[i + draw.randrange(2) :] for w in words]})
    got = {tuple(r) for r in matching.slips(spark.createDataFrame([(w,) for w in words], "name string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i, *[0] * len(b)]
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    assert got == {(x, y) for x in words for y in words if len(x) >= 6 and x != y and distance(x, y) <= (3 if len(x) >= 10 else 2)}


def test_equal_rows_of_one_source_are_one_entity(spark):
    left = [(1, BASE, "Smithson, John", "2001"), (2, BASE.upper(), "John Smithson", "2001"), (3, BASE, "Anna Kurzweil", "2009")]
    right = [(11, BASE, "Smithson, John", "2001"), (12, BASE, "Smithson, John", "2001"), (13, BASE, "Kurzweil, Anna", "2009")]
    found = matching.same_works(matching.match_entities([source(spark, 0, left), source(spark, 1, right)])).collect()
    assert sorted(tuple(r) for r in found) == [(1, 11), (1, 12), (2, 11), (2, 12), (3, 13)]


def test_subtitles_of_many_parts_are_read_whole(spark):
    long = lambda last: BASE + "".join(f": part {chr(97 + i % 26)}{chr(97 + i // 26)}x words" for i in range(60)) + f": {last}"
    left = [(1, long("a field survey"), "Smithson, John", "2001")]
    assert matching.same_works(matching.match_entities([source(spark, 0, left), source(spark, 1, [(2, long("a field survey"), "Smithson, John", "2001")])])).count() == 1
    assert matching.same_works(matching.match_entities([source(spark, 0, left), source(spark, 1, [(2, long("other hidden lamps"), "Smithson, John", "2001")])])).count() == 0


def test_messages_that_do_not_settle_are_told(spark, monkeypatch, caplog):
    monkeypatch.setattr(matching, "MOST_ROUNDS", 1)
    monkeypatch.setattr(matching, "TOLERANCE", 0.0)
    rows = [(1, 11, 0, 1, 1, 11, 2.0), (1, 12, 0, 1, 1, 12, 1.0), (2, 12, 0, 1, 2, 12, 1.0)]
    matching.belief(spark.createDataFrame(rows, "a_id long, b_id long, a_src int, b_src int, a_ent long, b_ent long, theta double")).collect()
    assert any("stopped after 1 rounds" in r.message for r in caplog.records)


@pytest.mark.parametrize("people", [2, 60])
def test_long_titles_score_the_pairs_that_all_pairs_give(spark, monkeypatch, people):
    draw = random.Random(people)
    word = lambda least, most: "".join(draw.choice("abcde") for _ in range(draw.randint(least, most))).capitalize()
    known = [(f"{word(7, 12)}, {word(4, 6)}", draw.randint(1980, 1990)) for _ in range(people)]

    def rows(first):
        for k in range(first, first + 60):
            authors, year = draw.choice(known)
            authors = draw.choices([authors, authors[:2] + "x" + authors[3:], authors.split(",")[0], "WHO", None], [6, 3, 3, 1, 0.5])[0]
            year = draw.choices([year, year + 1, year + 2, year - 5, None], [6, 2, 2, 1, 1])[0]
            yield k, "Letters from our editors" + draw.choice(["", "", ": of tides", ": of tide", ": on lamps and bells"]), authors, None if year is None else str(year)

    every = matching.cut(matching.prepared([source(spark, number, list(rows(1000 * number))) for number in range(3)]))
    held = matching.collapsed(matching.contenders(every, matching.keyed(every), []))[0]
    # Both kinds of title: one that bears other names, and one that does not.
    assert held.first()["n"] > matching.GENERIC_TITLE and (held.first()["works"] < 60) == (people == 2)

    def scores():
        return {(r["a_id"], r["b_id"]): r["theta"] for r in matching.scored(matching.candidates(held)).filter(F.col("theta") > matching.LEAST_SCORE).collect()}

    got = scores()
    monkeypatch.setattr(matching, "GENERIC_TITLE", 10**9)
    assert got == scores()


def test_pairs_are_the_same_under_titles_of_64_and_66_records(spark):
    # Names within a slip that two sources both have are two names; who has no names stays a candidate below even odds.
    left = [(1, "Editorial", "Smithson", "2001"), (2, "Editorial", "Smihtson", "1960"), (3, "Editorial", "WHO", None)]
    right = [(11, "Editorial", "Smihtson", "2001"), (12, "Editorial", "Smithson", "1960"), (13, "Editorial", "World Health Organisation", None)]

    def pairs(fillers):
        filler = [(100 + i, "Editorial", "Zz" + chr(97 + i // 26) * 4 + chr(97 + i % 26) * 4, str(1850 + i)) for i in range(fillers)]
        found = matching.match_entities([source(spark, 0, left + filler), source(spark, 1, right)]).collect()
        return {(r["left_id"], r["right_id"]): r["confidence"] for r in found}

    short, long = pairs(58), pairs(60)
    assert short.keys() == long.keys() and (3, 13) in long and (1, 11) not in long
    assert all(long[p] == pytest.approx(short[p], abs=0.05) for p in short)
