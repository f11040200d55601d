"""Golden cases and edges of the core operators."""

import pytest
from pyspark.sql import functions as F

from stackmill.functions import failures, grammar, identifiers, naming, urls
from stackmill.operators import exports, history, parsing, queue, rates, routing, topics, web
from stackmill.plans.ordered import numbered, with_next


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("url", "want"), [("HTTPS://User@Example.ORG:443/a?b#c", "https://example.org/a?b"), ("http://x.org:8080", "http://x.org:8080/"), (" not a url#frag ", "not a url"), ("https://x.org#top", "https://x.org/"), (None, None)])
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want


def test_hosts_and_domains(spark):
    assert one(spark, "https://www.A.example/x", urls.host) == "www.a.example"
    assert one(spark, "www.www.A.example..", urls.canonical_host) == "a.example"
    assert one(spark, "mailto:x", urls.domain) == "unknown"
    assert one(spark, "https://sub.b.example/x", lambda c: urls.host_within(c, "b.example")) is True
    assert one(spark, "https://notb.example/x", lambda c: urls.host_within(c, "b.example")) is False
    assert one(spark, "see b.example", lambda c: urls.host_within(c, "b.example")) is True


def test_grammar_urls_and_dois():
    assert [u for _, _, u in grammar.urls("see (https://x.org/a_(b)), then https://y.org/f.pdf.")] == ["https://x.org/a_(b)", "https://y.org/f.pdf"]
    assert grammar.dois("doi:10.90001/Ab(1) and https://doi.org/10.5555/x%2Fy, b10.5555/nine 7.10.5555/8 (10.5555/z)") == [("https://doi.org/10.5555/x%2Fy,", "10.5555/x/y"), ("doi:10.90001/Ab(1)", "10.90001/Ab(1)"), ("10.5555/z)", "10.5555/z")]
    assert grammar.known_ids("PMC70717\narXiv: 2207.40417v3\nPMID 99\npmc70717\nPMID99") == [("PMC70717", "PMC70717"), ("arXiv: 2207.40417v3", "2207.40417v3"), ("PMID 99", "PMID:99")]


def test_items_keep_the_contract_order():
    text = "Smith, J. (2020). A long title. Journal of X.\n@article{k, title={A {b} c}, doi={10.1111/bib}}\nhttps://x.org/1 10.2222/text\nPMC7071767"
    assert [(kind, value[:10]) for _, kind, _, value in grammar.items(text)] == [("doi", "10.1111/bi"), ("doi", "10.2222/te"), ("url", "https://x."), ("unknown", "PMC7071767"), ("reference", "Smith, J. "), ("bibtex", "k"), ("reference", "A {b} c.")]
    assert grammar.items("") == [] and grammar.items("a, b, c") == []


def test_references(spark):
    found = parsing.references(spark.createDataFrame([(1, "Smith, J., Doe, Anna (2019). Deep parts. Journal."), (2, "Brown et al. 2015 Short one here"), (3, "nothing to see")], "input_id long, text string")).orderBy("input_id").collect()
    assert (found[0]["authors"], found[0]["year"], found[0]["title"], found[0]["confidence"]) == (["Smith, J.", "Doe, Anna"], 2019, "Deep parts", "high")
    assert found[1]["authors"] == ["Brown et al."] and found[2]["confidence"] == "low"


def test_identifiers(spark):
    assert one(spark, "https://arxiv.org/pdf/2207.40417v3.pdf", lambda c: identifiers.arxiv_id(c, F.lit("url"))) == "2207.40417v3"
    assert one(spark, "https://dl.acm.org/doi/10.1145/900100.900213/extra", identifiers.acm_doi) == "10.1145/900100.900213"
    assert one(spark, "https://youtube.com/watch?a=1&v=Q9", identifiers.video_id) == "Q9"
    assert one(spark, " DOI: 10.5555/A%2FB ", identifiers.registry_doi) == "10.5555/a/b"
    assert one(spark, "doi:", identifiers.registry_doi) is None


def test_names(spark):
    assert one(spark, " a / b:: c ", naming.project_name) == "a-b-c"
    assert one(spark, "x/../y", naming.project_folder) is None
    assert one(spark, "con/a", naming.project_folder) == "con-project/a"
    assert one(spark, "Smith, John", naming.sidecar_authors) == ["Smith, John"]
    assert one(spark, "John Smith, Ann Lee", naming.sidecar_authors) == ["John Smith", "Ann Lee"]
    assert one(spark, "a; ;b", naming.sidecar_authors) == ["a", "b"]
    assert one(spark, None, naming.sidecar_authors) == []


def test_failures_and_retries(spark):
    assert one(spark, "[AUTH] authentication required for x.org (HTTP 403)", failures.auth_domain) == "x.org"
    assert one(spark, 408, failures.status_class, "int") == "transient" and one(spark, 451, failures.status_class, "int") == "permanent"
    delays = rates.retry_schedule(spark.createDataFrame([(1, "transient"), (2, "permanent")], "id long, failure string"), 8).orderBy("id", "attempt").collect()
    assert [r["delay_ms"] for r in delays] == [0, 1000, 2000, 4000, 8000, 16000, 32000, 32000, 0]
    assert len(rates.retry_schedule(spark.createDataFrame([(1, "transient")], "id long, failure string"), 0).collect()) == 1


def test_schedule_equals_simulation(spark):
    rows = [(i, f"h{i % 2}", (i * 7919) % 5000) for i in range(200)]
    got = {r["id"]: r["start_ms"] for r in rates.request_schedule(spark.createDataFrame(rows, "id long, domain string, arrived_ms long"), 100, bucket_ms=700).collect()}
    last: dict[str, int] = {}
    for i, domain, arrived in sorted(rows, key=lambda r: (r[2], r[0])):
        last[domain] = max(arrived, last[domain] + 100) if domain in last else arrived
        assert got[i] == last[domain]


def test_state_fold_and_lookup(spark):
    events = spark.createDataFrame([(1, 1, "pending"), (1, 2, "completed"), (2, 1, "pending"), (2, 3, "removed")], "id long, seq long, status string")
    assert [(r["id"], r["status"]) for r in queue.folded(events).collect()] == [(1, "completed")]
    items = spark.createDataFrame([(1, "doi:a", "url:x"), (2, "doi:b", "url:y"), (3, None, "url:z")], "id long, doi_key string, url_key string")
    registry = spark.createDataFrame([("doi:a", True), ("url:y", False)], "dedup_key string, present boolean")
    assert {r["id"]: r["outcome"] for r in queue.looked_up(items, registry).collect()} == {1: "hit", 2: "stale", 3: "miss"}


def test_search_order(spark):
    rows = [(1, "u", "success", "f", "deep work", None, None, "2020"), (2, "u", "success", "f", "the deep work of all", None, None, "2021"), (3, "u", "success", "f", "deep wrk", None, None, "2022"), (4, "u", "success", "f", "other", "Deep Work", None, "2019")]
    found = history.ranked(spark.createDataFrame(rows, "id long, url string, status string, file_path string, title string, authors string, doi string, started_at string"), " Deep  WORK ", 10).collect()
    assert [(r["id"], r["match_kind"], r["matched_field"]) for r in found] == [(1, 3, "title"), (4, 3, "authors"), (2, 2, "title"), (3, 1, "title")]
    with pytest.raises(ValueError, match="since"):
        history.attempts(spark.createDataFrame([], "started_at string, id long"), since="2", until="1")


def test_pages_robots_cookies(spark):
    html = "<META property='og:x' content='a &amp;lt; b'><meta content=\"t\" name=\"citation_title\"><meta charset=utf-8>"
    tags = one(spark, html, web.meta_tags)
    assert [tuple(t) for t in tags] == [("og:x", "a < b"), ("citation_title", "t")]
    files = spark.createDataFrame([("https://x.org", "User-agent: a\nUser-agent: *\nDisallow: /p*\nuser-agent: b\nDisallow: /q\nUser-agent: c\nDisallow: /r\n")], "origin string, body string")
    asked = spark.createDataFrame([(1, "https://x.org/p/1"), (2, "https://x.org/q"), (3, "https://x.org/r"), (4, "https://y.org/p")], "id long, url string")
    assert sorted(r["id"] for r in web.allowed(asked, web.robots_rules(files)).collect()) == [3, 4]
    cookies = web.json_cookies(spark.createDataFrame([('[{"domain":".a.org","name":"n","value":"v","expirationDate":12.7}]',), ('{"cookies":[{"host":"b.org","name":"m","value":""}]}',), ("junk",)], "text string")).collect()
    assert sorted((c["domain"], c["expires"], c["path"], c["tailmatch"]) for c in cookies) == [(".a.org", 12, "/", True), ("b.org", 0, "/", False)]


def test_routes(spark):
    items = [("10.1109/x", "doi", "ieee"), ("https://doi.org/10.1093/x", "url", "oxford"), ("https://www.sciencedirect.com/science/article/pii/S1.pdf", "url", "direct"), ("10.9999/x", "doi", "crossref"), ("PMID:12", "unknown", "pubmed"), ("Smith 2020", "reference", None), ("@article{", "bibtex", None), ("https://www.mdpi.com/2076-3417/1/2/3/pdf", "url", "mdpi")]
    got = spark.createDataFrame(items, "v string, k string, want string").select("want", routing.route(F.col("v"), F.col("k")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_redirect_loop_ends(spark):
    items, hops = spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("a", "b"), ("b", "a")], "url string, target string")
    assert routing.chased(items, hops, 4).first()["final_url"] is None


def test_topics_and_rake(spark):
    df = spark.createDataFrame([(["B", " a ", "", "b"],)], "t array<string>")
    assert df.select(topics.normal_topics("t").alias("r")).first()["r"] == ["a", "b"]
    docs = spark.createDataFrame([(1, "Linear constraints over the set of natural numbers. Linear constraints."), (2, ""), (3, None)], "doc_id long, text string")
    best = topics.rake(docs).filter("rank = 1").collect()
    assert [(r["doc_id"], r["phrase"], r["score"]) for r in best] == [(1, "linear constraints", 4.0)]


def test_rake_keeps_long_phrases(spark):
    docs = spark.createDataFrame([(1, "Cold tidal river delta sediment core samples are dry. Tidal samples.")], "doc_id long, text string")
    got = [(r["rank"], r["phrase"], r["score"]) for r in topics.rake(docs).orderBy("rank").collect()]
    assert got == [(1, "cold tidal river delta sediment core samples", 44.0), (2, "tidal samples", 9.0), (3, "dry", 1.0)]


def test_exports(spark):
    corpus = spark.createDataFrame([("c/a.json", "A & B", ["Ann Lee", "Roe, R."], "2017-06-12", None, "https://x.org/1_2"), ("c/b.json", None, [], None, None, None)], "path string, title string, authors array<string>, date string, doi string, url string")
    entries = [r["entry"] for r in exports.bibtex_entries(corpus).orderBy("path").collect()]
    assert entries == ["@article{lee2017,\n  title     = {A \\& B},\n  author    = {Ann Lee and Roe, R.},\n  year      = {2017},\n  url       = {https://x.org/1_2}\n}", "@article{b,\n}"]
    assert exports.ris_records(corpus).orderBy("path").first()["entry"] == "TY  - JOUR\nTI  - A & B\nAU  - Ann Lee\nAU  - Roe, R.\nPY  - 2017\nUR  - https://x.org/1_2\nER  - \n"


def test_ordered_helpers(spark):
    rows = [("hot", f"{i:04d}") for i in range(500)] + [("x", "b"), ("x", "a")]
    got = {(r["k"], r["v"]): r["next"] for r in with_next(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()}
    assert got[("hot", "0000")] == "0001" and got[("hot", "0499")] is None and got[("x", "a")] == "b" and sum(v is None for v in got.values()) == 2
    got = {r["i"]: r["n"] for r in numbered(spark.createDataFrame([("k", i) for i in range(0, 100, 3)], "k string, i long"), ["k"], "i", "n", bucket=10).collect()}
    assert got == {i: n for n, i in enumerate(range(0, 100, 3))}
