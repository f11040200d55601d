"""Search over attempts with accents and without titles, against brute force."""

import re

from stackmill.plans import catalog

QUERY = "granular"
ROWS = [
    (1, "Granular flow in crêpe mills", "Ann Lee", None),
    (2, None, "Granular Research Group", None),
    (3, None, None, "10.5555/granular"),
    (4, "Gränular", "Åsa Lönn", None),
    (5, "Notes on granúlar matter", None, None),
    (6, "GRANULAR", "Jörg Weiß", None),
    (7, "Ripples of the tide", "Bjørn Dahl", "10.5555/x"),
    (8, None, None, None),
    (9, "Granulat", "O. Quist", None),
    (10, "Гranular beds", None, "10.5555/granular.é"),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def brute(rows):
    found = []
    for i, *fields in rows:
        options = []
        for rank, (name, value) in enumerate(zip(("title", "authors", "doi"), fields, strict=True)):
            text = " ".join((value or "").split()).lower()
            alike = max([1 - distance(QUERY, t) / max(len(QUERY), len(t)) for t in [text, *[w for w in re.split(r"[\W_]+", text) if len(w) >= 3]]])
            kind, likeness = (3, 1.0) if text == QUERY else (2, len(QUERY) / len(text)) if QUERY in text else (1, alike) if alike >= 0.86 else (0, 0.0)
            if kind:
                options.append((kind, round(likeness, 6), -rank, name))
        if options:
            kind, likeness, _, name = max(options)
            found.append((i, kind, likeness, name))
    return sorted(found)


def test_search_ranked_reads_every_attempt(spark, tmp_path):
    log = [(i, f"https://x.example/{i}", "success", None, t, a, d, f"2022-01-{i:02d} 00:00:00", i) for i, t, a, d in ROWS]
    spark.createDataFrame(log, "id long, url string, status string, file_path string, title string, authors string, doi string, started_at string, logged_at long").write.parquet(f"{tmp_path}/download_log.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["search_ranked"](spark, str(tmp_path)).collect())
    assert got == brute(ROWS)
    assert {2, 3, 4, 5, 6, 10} <= {r[0] for r in got}
