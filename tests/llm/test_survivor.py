"""Problem 3: the best value of each field."""

import random
from datetime import datetime, timedelta

from stackmill.llm import survivor
from stackmill.operators.packed_values import dialect_codes

TRUST = {"crossref": 90, "web": 40, "guess": 5}


def frames(spark, rows):
    schema = "meta_id long, dedup_key string, resolver string, title string, authors string, year string, resolved_at timestamp, trust long, form string"
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], schema), spark.createDataFrame(list(TRUST.items()), "resolver string, trust int")


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    out = set()
    for key, group in groups.items():
        if len(group) < 2:
            continue
        bare = lambda t: (t or "").lower().rstrip(" .")
        count = lambda a: 0 if a in (None, "unknown") else len([x for x in a.replace("; et al.", "").split(";") if x.strip()])
        most = max(count(r[4]) for r in group)
        whole = {
            "title": lambda r: r[3] not in (None, "", "Untitled") and not r[3].endswith("…") and not any(o[3] and o[3] != "Untitled" and bare(o[3]) != bare(r[3]) and bare(o[3]).startswith(bare(r[3])) for o in group),
            "authors": lambda r: r[4] not in (None, "unknown") and "et al" not in r[4] and count(r[4]) == most,
            "year": lambda r: r[5] is not None and r[5][:4].isdigit() and 1800 <= int(r[5][:4]) <= 2099,
        }
        for field, ok in whole.items():
            held = [r for r in group if ok(r)]
            best = [r for r in held if all(TRUST.get(o[2], -1) <= TRUST.get(r[2], -1) and o[6] <= r[6] for o in held)]
            if best:
                out.add((key, field, min(r[0] for r in best)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    titles = [None, "", "Untitled", "Deep parts of things", "deep parts of things.", "Deep parts", "Deep par…", "Other work"]
    authors = [None, "unknown", "Smithson, A.; Doering, B.", "Smithson, A.; et al.", "A. Smithson", "Smithson, A.; Doering, B.; Roemer, C."]
    years = [None, "2001", "2001-05-06", "19", "in press", "1700"]
    at = datetime(2022, 1, 1)
    rows = [(i, rng.choice(["k1", "k2", None, *[f"s{j}" for j in range(40)]]), rng.choice([*TRUST, None]), rng.choice(titles), rng.choice(authors), rng.choice(years), at + timedelta(hours=rng.randrange(30))) for i in range(400)]
    df, resolvers = frames(spark, rows)
    got = {tuple(r) for r in survivor.clear_winners(survivor.survivors(df, resolvers)).collect()}
    assert got == brute(rows)


def test_prefix_hides_behind_case_and_look_alikes(spark):
    at = datetime(2022, 1, 1)
    rows = [(1, "k", "crossref", "DEEP Pаrts", None, "2001/2002", at), (2, "k", "guess", "Deep parts of things", "X Y", None, at - timedelta(days=1))]
    df, resolvers = frames(spark, rows)
    best = survivor.survivors(df, resolvers).first()
    assert best["title_id"] == 2 and best["title"] == "Deep parts of things" and best["year"] is None and best["captures"] == 2
    assert survivor.survivors(df.limit(0), resolvers, dialect_codes(df.limit(0).selectExpr("authors AS text"))).count() == 0


def test_hot_key_and_ties(spark):
    at = datetime(2022, 1, 1)
    rows = [(i, "hot", "web", "Same title", "A. Name", "2001", at) for i in range(2000)] + [(5000, "solo", "web", "T", None, None, at)]
    df, resolvers = frames(spark, rows)
    best = {r["dedup_key"]: r for r in survivor.survivors(df, resolvers).collect()}
    assert best["hot"]["title_id"] == best["hot"]["year_id"] == 0 and best["hot"]["captures"] == 2000 and best["solo"]["title_id"] == 5000
