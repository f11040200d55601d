"""Problem 5: names typed by people."""

import random

import pytest

from stackmill.llm import names


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        nxt = [i]
        for j, d in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (c != d)))
        row = nxt
    return row[-1]


def test_segment_join_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    reference = sorted({word(rng.randrange(1, 14)) for _ in range(120)})
    typed = set(reference[:20])
    for w in reference:
        for _ in range(3):
            s = list(w)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(s) + 1)
                rng.choice([lambda: s.insert(i, rng.choice("abcd")), lambda: s and s.pop(i % len(s))])()
            typed.add("".join(s))
    typed = sorted(t for t in typed if t)
    table = lambda words: spark.createDataFrame([("p", w) for w in words], "kind string, key string")
    got = {(r["key"], r["entity_key"]): r["edits"] for r in names.segment_links(table(typed), table(reference)).collect()}
    reach = lambda t, w: lev(t, w) if (d := lev(t, w)) == 0 or (len(w) > 2 and len(t) >= 2 and d <= 2 and (d <= len(w) // 4 or sorted(t) == sorted(w))) else None
    want = {(t, w): reach(t, w) for t in typed for w in reference if reach(t, w) is not None}
    assert got == want


@pytest.fixture(scope="module")
def reference(spark):
    rows = [(1, "person", "Dallakerrgh", "Thomas", "W"), (2, "person", "Ekkömarberg", "Charles", None), (3, "person", "Nerremille", "Inês", None), (4, "person", "Nerremille", "Francisco", "T"), (5, "organisation", "Oskabelley Centre for Acoustics Research", None, None), (6, "organisation", "International Society for Acoustics, Corvushijak Section", None, None), (7, "person", "Twinsworth", "Anna", None), (8, "person", "Twinsworth", "Alice", None), (None, "person", "X", "Y", None), (9, "person", None, "Y", None)]
    return spark.createDataFrame([r + ("n",) for r in rows], "entity_id long, kind string, family string, given string, middle string, name string")


@pytest.mark.parametrize(
    ("typed", "entity"),
    [
        ("Dallakerrgh, T. W.", 1), ("Tom Dallakrergh", 1), ("DALLAKERRGH Thomas", 1), ("Dallakerrgh, Thmas", 1), ("T.W. Dallakergh", 1), ("Dallakerrgh, Margaret", None), ("Dallakerrgh, T. X.", None),
        ("Chuck Ekkoemarberg", 2), ("C. Ekkomarberg", 2), ("I. Nerremille", 3), ("Paco Nerremille", 4), ("Nerremille, Rafael", None), ("Thomas, Dallakerrgh", 1), ("Dallakerrgh, Thomas, Jr.", 1),
        ("Oskabelley Ctr. for Acoustics Res.", 5), ("The oskabelley centre for acoustics reserach", 5), ("ISACS", 6), ("Intl. Soc. for Acoustics, Corvushijak Sect.", 6), ("A. Twinsworth", None), ("Anna Twinsworth", 7), ("Dallakerrgh", None),
        ("Prof. Dr. Thomas W. Dallakerrgh", 1), ("Dallakerrgh, Prof. Dr. Thomas", 1), ("Thomas W. von der Au Dallakerrgh", 1), ("Dr Dr Dr Dr Dr", None), ("", None), (None, None), ("—", None),
    ],
)
def test_links(spark, reference, typed, entity):
    rows = spark.createDataFrame([(10, 1, typed), (10, 1, typed)], "record_id long, pos int, name string")
    assert [r["entity_id"] for r in names.link_names(rows, reference).collect()] == ([entity] if entity else [])


def test_edges(spark, reference):
    rows = spark.createDataFrame([(i, 1, "Dallakerrgh, T.") for i in range(500)] + [(900, 2, "x" * 20_000)], "record_id long, pos int, name string")
    assert names.link_names(rows, reference).count() == 500
    assert names.link_names(rows.limit(0), reference).count() == 0 and names.link_names(rows, reference.limit(0)).count() == 0
