"""Addresses, pages, failures, reports, settings, sources and streams."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from stackmill.functions import failures, metadata, urls
from stackmill.operators import exports, history, rates, routing, topics, web
from stackmill.plans.ordered import numbered_table, unique_names
from stackmill.sources import config, files
from stackmill.streaming import jobs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("ending", urls.BINARY_EXTENSIONS)
def test_every_binary_extension(spark, ending):
    assert one(spark, f"https://x.example/a{ending.upper()}?q=1", urls.expects_binary) is True


@pytest.mark.parametrize("ending", [".mp3", ".7z", ".html", ".tar", ""])
def test_other_extensions(spark, ending):
    assert one(spark, f"https://x.example/a{ending}", urls.expects_binary) is False


def test_login_redirects(spark):
    rows = [("https://a.example/p.pdf", "text/html; x", "https://sso.b.example/SAML/x", "sso.b.example"), ("https://a.example/p.pdf", "application/pdf", "https://b.example/login", None), ("https://a.example/p", "text/html", "https://b.example/login", None), ("https://a.example/p.pdf", "text/html", "https://a.example/error", None), ("https://a.example/p.pdf", None, None, None)]
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "u string, t string, f string, want string, i int").select("i", "want", urls.login_domain(F.col("u"), F.col("t"), F.col("f")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_entities_and_tags(spark):
    raw = "a&nbsp;b &#8211; &#8212; &#160;c &amp;lt; &quot;x&quot; &#39; &ndash;&mdash; &gt;"
    assert one(spark, raw, web.unescaped) == "a\u00a0b \u2013 \u2014 \u00a0c < \"x\" ' \u2013\u2014 >"
    html = '<meta name="dc.title" content="second"><meta property="citation_title" content="  first &amp; last ">'
    assert one(spark, html, lambda c: web.first_meta(web.meta_tags(c), "citation_title", "dc.title")) == "second"
    assert one(spark, html, lambda c: web.meta_value(c, "citation_title")) == "first &amp; last"


def test_walls(spark):
    page = lambda html, url, who: spark.createDataFrame([(html, url)], "h string, u string").select(web.wall(F.col("h"), F.col("u"), who).alias("r")).first()["r"]
    assert page("Sign in or PURCHASE PDF", "https://x.example/a", "ieee") and not page("sign in", "https://x.example/a", "ieee")
    assert page("x", "https://x.example/servlet/Login", "ieee") and page("This PDF is available to subscribers only", "https://x.example/", "oxford")
    assert not page("x", "https://x.example/login", "springer") and page("go to ID.elsevier.com", "https://x.example/", "sciencedirect") and not page("sign in shibboleth", "https://x.example/", "sciencedirect")


def test_cookies_of_both_forms(spark):
    texts = [(1, '[{"domain":"https://a.org/x","name":" n ","value":"v","expirationDate":12.7},{"name":"m","value":"v"},{"domain":"b.org","name":"","value":"v"},{"host":".c.org","hostOnly":true,"name":"k","value":""}]'), (2, "# c\n\n.d.org\tTRUE\t/\tFALSE\t0\tn\tv\r\nbad line\n.e.org\tTRUE\t/\tNO\t0\tn\tv\n.f.org\tTRUE\t/\tTRUE\t-5\tn\tv\n\tTRUE\t/\tTRUE\t5\tn\tv"), (3, "{broken")]
    got = web.captured_cookies(spark.createDataFrame(texts, "capture long, text string"), 100).collect()
    by = lambda i: sorted((r["domain"] or "", r["problem"] or "") for r in got if r["capture"] == i)
    assert by(1) == [("", "no domain"), ("a.org", "expired"), ("b.org", "no name"), ("c.org", "no value")]
    assert by(2) == [("", "no domain"), (".d.org", ""), (".e.org", "flag is neither TRUE nor FALSE"), (".f.org", "expiry is no number"), ("bad line", "not seven fields")] and by(3) == []


def test_failures(spark):
    rows = [("auth", 407, None), ("auth", 403, None), (None, None, "x timeout"), (None, None, "odd\n  Suggestion: do this "), (None, None, None)]
    got = spark.createDataFrame(rows, "t string, s int, m string").select(failures.suggestion(F.col("t"), F.col("s"), F.col("m")).alias("r")).collect()
    assert [r["r"] for r in got] == [failures.REMEDIES["Proxy authentication required"][1], failures.REMEDIES["Authentication required"][1], failures.REMEDIES["Network request failed"][1], "do this", failures.REMEDIES["Network request failed"][1]]
    kinds = [("network", None, "TLS handshake failed", "permanent", "network"), ("network", None, "reset", "transient", "network"), ("io", None, "disk", "permanent", "network"), ("http_status", 404, "x", "permanent", "not_found"), ("invalid_url", None, "x", "permanent", "parse_error"), ("auth", 401, "x", "needs_auth", "auth")]
    got = spark.createDataFrame(kinds, "k string, s int, m string, c string, t string").select("c", "t", failures.error_class(F.col("k"), F.col("s"), F.col("m")).alias("gc"), failures.error_type(F.col("k"), F.col("s")).alias("gt")).collect()
    assert all(r["c"] == r["gc"] and r["t"] == r["gt"] for r in got)
    lines = exports.failure_summary(spark.createDataFrame([("[AUTH] authentication required for b.org (HTTP 403)",), ("[AUTH] authentication required for a.org (HTTP 401)",), ("HTTP 404",), (None,)], "message string"), 200).orderBy("place").collect()
    assert [r["row"] for r in lines][0] == "Failure summary by category:" and "Affected domains: a.org (1), b.org (1)" in lines[3]["row"] and len(lines) == 13
    assert exports.failure_summary(spark.createDataFrame([], "message string")).count() == 0


def test_log_and_index_rows(spark):
    log = spark.createDataFrame([(7, "2022-01-02 03:04:05", "failed", "d/a.pdf", "T", None, "https://x", "first\nsecond", "p"), (8, "t", "success", None, None, "typed", "https://x", None, "p")], "id long, started_at string, status string, file_path string, title string, original_input string, url string, error_message string, project string")
    assert [r["row"] for r in exports.log_rows(log).orderBy("id").collect()] == ["- 2022-01-02 03:04:05 | FAILED | file=a.pdf | source=https://x | reason=first | ref=history#7", "- t | SUCCESS | file=n/a | source=typed | ref=history#8"]
    assert [r["line"] for r in exports.log_section(log, 7, F.lit("s")).orderBy("part", "id").collect()] == ["## Session s (1 attempts)", "", "- t | SUCCESS | file=n/a | source=typed | ref=history#8"]
    items = spark.createDataFrame([(1, "completed", "d/a|b.pdf", None, "A `x`", "https://x", "p", '["B","a"]')], "id long, status string, saved_path string, meta_title string, meta_authors string, url string, project string, topics string")
    got = [r["line"] for r in exports.index_section(items, items.limit(0), F.lit("s")).orderBy("part", "id").collect()]
    assert got == ["## Session s", "", "**Topics detected:** 2 | a, b", "", *exports.INDEX_HEAD, "| `a\\|b.pdf` | n/a | A \\`x\\` | <https://x> |"]


def test_names_stay_unique(spark):
    rows = [(1, "p", "a.pdf"), (2, "p", "a.pdf"), (3, "p", "a_1.pdf"), (4, "p", "a.pdf"), (5, "q", "a.pdf"), (6, "p", "a_3.pdf"), (7, "p", "a.pdf"), (8, "p", "b"), (9, "p", "b")]
    got = {r["id"]: r["unique_name"] for r in unique_names(spark.createDataFrame(rows, "id long, p string, n string"), "p", "n", "id").collect()}
    assert got == {1: "a.pdf", 2: "a_2.pdf", 3: "a_1.pdf", 4: "a_4.pdf", 5: "a.pdf", 6: "a_3.pdf", 7: "a_5.pdf", 8: "b", 9: "b_1"}
    assert sorted((r["o"], r["n"]) for r in numbered_table(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "o long"), "o", "n").collect()) == [(i, i) for i in range(50)]


def test_resolved_and_chased(spark):
    rows = [("arXiv:2101.00001", "unknown", "no_resolver", None), ("2101.00001", "unknown", "url", "https://arxiv.org/pdf/2101.00001.pdf"), ("10.1145/12", "doi", "url", "https://dl.acm.org/doi/pdf/10.1145/12"), ("10.9999/x", "doi", "all_failed", None), ("https://x.example/a", "url", "url", "https://x.example/a"), ("Holm 2020", "reference", "no_resolver", None)]
    got = spark.createDataFrame(rows, "v string, k string, step string, url string").select("v", "step", "url", routing.resolved(F.col("v"), F.col("k")).alias("r")).collect()
    assert all((r["r"]["step"], r["r"]["url"]) == (r["step"], r["url"]) for r in got)
    mine = routing.registered(routing.RULES, routing.Rule("mine", 0, lambda v, k: k == "reference"))
    assert one(spark, "x", lambda c: routing.route(c, F.lit("reference"), mine)) == "mine"
    items = spark.createDataFrame([(1, "a", "doi"), (2, "z", "doi")], "id long, url string, kind string")
    hops = spark.createDataFrame([("a", "b"), ("b", "c")], "url string, target string")
    assert sorted((r["id"], r["final_url"], r["hops"], r["kind"]) for r in routing.chased(items, hops).collect()) == [(1, "c", 2, "url"), (2, "z", 0, "doi")]


def test_retries_told_by_servers(spark):
    df = spark.createDataFrame([(1, "rate_limited", 429, 7), (2, "needs_auth", 403, None), (3, "needs_auth", 401, None)], "id long, failure string, http_status int, retry_after_s long")
    got = [(r["id"], r["attempt"], r["delay_ms"], r["as_browser"]) for r in rates.retry_schedule(df).orderBy("id", "attempt").collect()]
    assert got == [(1, 1, 0, False), (1, 2, 7000, False), (1, 3, 7000, False), (2, 1, 0, False), (2, 2, 0, True), (3, 1, 0, False)]


def test_newest_page_folds_deliveries(spark):
    rows = [(i, f"s{i % 3}", f"2022-01-{i:02d}", d) for i in range(1, 29) for d in range(1 + i % 2)]
    log = spark.createDataFrame(rows, "id long, status string, started_at string, logged_at long")
    got = [(r["id"], r["logged_at"]) for r in history.newest(log.filter("status = 's1'"), ["started_at", "id"], 3).collect()]
    assert got == [(28, 0), (25, 1), (22, 0)]
    more = history.merged_sources(log.withColumn("source", F.lit("x")), "source", 5).collect()
    assert len(more) == 5 and all(r["truncated"] for r in more)


def test_settings():
    got = config.parsed('output_dir = "a # b" # c\nconcurrency=5\nrespectful = false\n\n# x\n')
    assert got == {"output_dir": "a # b", "concurrency": 5, "respectful": False}
    for wrong in ("x = 1", "concurrency", "concurrency = 0", "concurrency = many", "respectful = yes", 'output_dir = "open'):
        with pytest.raises(ValueError, match="line 1"):
            config.parsed(wrong)
    assert config.effective({"concurrency": 5, "respectful": True}, {"concurrency": 9})["concurrency"] == 2
    assert config.effective({"concurrency": 5}, {"concurrency": 9}) == {"concurrency": 9}


def test_history_databases(spark, tmp_path):
    for name, ids in (("one", [1, 2]), ("two/deep", [1])):
        at = tmp_path / name / ".state"
        at.mkdir(parents=True)
        con = sqlite3.connect(at / "queue.db")
        con.execute("CREATE TABLE download_log (id INTEGER, url TEXT, status TEXT, retry_count INTEGER)")
        con.executemany("INSERT INTO download_log VALUES (?, 'u', 'failed', 2)", [(i,) for i in ids])
        con.commit()
        con.close()
    (tmp_path / "bad" / ".state").mkdir(parents=True)
    (tmp_path / "bad" / ".state" / "queue.db").write_bytes(b"junk")
    (tmp_path / "queue.db").write_bytes(b"not in a hidden folder")
    got = files.history_databases(spark, str(tmp_path)).collect()
    assert sorted((r["source"].split("/")[-4:][1], r["id"]) for r in got) == [("deep", 1), ("one", 1), ("one", 2)] and all(r["title"] is None and r["retry_count"] == 2 for r in got)
    assert files.history_databases(spark, str(tmp_path), "queue").count() == 0
    assert files.project_folders(spark, str(tmp_path / "none")) == [] and sorted(files.project_folders(spark, str(tmp_path))) == ["bad", "one", "two"]
    assert files.in_memory(spark.range(3), "mine").count() == 3


def test_inputs(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{k, title={T}}")
    (tmp_path / "b.RIS").write_text("TY  - JOUR\nER  -")
    bib, ris = files.bibliography_inputs(spark, [str(tmp_path / "a.bib"), str(tmp_path / "b.RIS")])
    assert bib.count() == 1 and ris.first()["text"].startswith("TY")
    with pytest.raises(ValueError, match="Fix"):
        files.bibliography_inputs(spark, ["x.txt"])
    part = lambda *rows: spark.createDataFrame(list(rows), "input_id long, ord long, text string")
    got = files.joined_input(files.merged_input(part((1, 2, "b"), (1, 1, "a")), part((1, 1, "  "), (1, 2, "piped")), part((1, 1, "@x")))).first()
    assert got["text"] == "a\nb\npiped\n@x"


def test_registry_snapshots(spark, tmp_path):
    good = '{"schema_version":1,"project_key":"p","items":[{"dedup_key":"doi:x","relative_path":"a"}]}'
    for name, text in (("good", good), ("other", good.replace('"p"', '"q"')), ("bad", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(text)
    of = lambda name: files.registry_snapshots(spark, str(tmp_path / name), "p")
    assert [files.registry_is_dirty(of(n)).first()["dirty"] for n in ("good", "other", "bad")] == [False, True, True]
    assert files.registry(spark, str(tmp_path / "good"), "p").first()["dedup_key"] == "doi:x" and files.registry(spark, str(tmp_path / "bad"), "p").count() == 0


def test_journal_names(spark):
    slug = lambda title: spark.createDataFrame([(title,)], "t string").select(metadata.slug_candidates(F.col("t"), F.lit("app")).alias("r")).first()["r"]
    assert slug(None) == ["app"] and slug("Sensors") == ["sensors"] and slug("Applied Sciences") == ["appliedsciences", "app", "applsci"]


def test_title_and_abstract(spark):
    assert one(spark, None, lambda c: topics.title_and_abstract(F.lit("T"), c)) == "T" and one(spark, "a b", lambda c: topics.title_and_abstract(F.lit("T"), c)) == "T. T. a b"


def test_stream_of_cached_rules_equals_brute_force(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.example/x", i * 37 % 1000) for i in range(300)]
    spark.createDataFrame(rows, "id long, url string, at_ms long").coalesce(1).write.parquet(f"{tmp_path}/r.parquet")
    got = {(r["origin"], r["id"]) for r in jobs.drained(jobs.rules_to_read(jobs.table_stream(spark, str(tmp_path), "r"), 100, ends=False)).collect()}
    want, last = set(), {}
    for i, url, at in sorted(rows, key=lambda r: (r[2], r[0])):
        o = url[:-2]
        if o not in last or at - last[o] > 100:
            last[o] = at
            want.add((o, i))
    assert got == want


def test_stream_work_and_progress(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    seen, told = [], []
    teller = jobs.ProgressTeller(lambda name, batch, rows: told.append(rows), 0)
    spark.streams.addListener(teller)
    query = jobs.consumed(jobs.table_stream(spark, str(tmp_path), "t"), lambda batch, n: seen.append(batch.count()))
    assert jobs.stopped(query, 60) is True and sum(seen) == 10
    spark.streams.removeListener(teller)
