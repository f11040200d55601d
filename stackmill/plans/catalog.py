"""Named queries over the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import failures, identifiers, metadata, naming, urls
from stackmill.operators import exports, history, parsing, queue, rates, routing, topics, web
from stackmill.plans import catalog_runs, catalog_texts, views
from stackmill.plans.catalog_sql import ORACLE_SQL
from stackmill.plans.ordered import unique_names
from stackmill.sources.tables import table
from stackmill.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**catalog_runs.QUERIES, **catalog_texts.QUERIES}
ORACLE_SQL |= catalog_runs.ORACLE_SQL | catalog_texts.ORACLE_SQL
ATTEMPT_COLUMNS = ["id", "url", "status", "project", "started_at", "error_type", "retry_count"]
EPOCH, SPACING_MS = 1_700_000_000, 5_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- history -----------------------------------------------------------------------------------


@query
def log_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The newest attempts."""
    return history.attempts(views.deliveries(spark, folder)).select(*ATTEMPT_COLUMNS)


@query
def log_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return history.attempts(views.deliveries(spark, folder), status="failed", limit=50).select(*ATTEMPT_COLUMNS)


@query
def log_by_project(spark: SparkSession, folder: str) -> DataFrame:
    return history.attempts(views.deliveries(spark, folder), project="basalt-corpus", limit=10_000).select(*ATTEMPT_COLUMNS)


@query
def log_since_until(spark: SparkSession, folder: str) -> DataFrame:
    """Both bounds included, compared as text."""
    return history.attempts(views.deliveries(spark, folder), since="2022-03-01 00:00:00", until="2022-09-30 23:59:59", limit=10_000).select(*ATTEMPT_COLUMNS)


@query
def log_keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return history.attempts(views.deliveries(spark, folder), after_id=100, before_id=2000, limit=100).select(*ATTEMPT_COLUMNS)


@query
def log_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """The domain decides before the limit."""
    return history.attempts(views.deliveries(spark, folder), domain=" .loomstudies.test", limit=100).select(*ATTEMPT_COLUMNS)


@query
def log_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    return history.attempts(views.deliveries(spark, folder), uncertain_only=True, limit=500).select(*ATTEMPT_COLUMNS)


@query
def log_confidence_json(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts by what their stored confidence factors say."""
    factors = F.from_json("parse_confidence_factors", "has_authors boolean, has_year boolean, has_title boolean, author_count bigint")
    held = views.attempts(spark, folder, "parse_confidence_factors IS NOT NULL").withColumn("f", factors).filter("f IS NOT NULL")
    return held.groupBy("f.has_authors", "f.has_year", "f.has_title").agg(F.count("*").alias("attempts"), F.sum("f.author_count").alias("authors"))


@query
def log_multi_source(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of every project's history, merged."""
    log = views.deliveries(spark, folder).withColumn("source", F.coalesce("project", F.lit("")))
    return history.merged_sources(log, "source", 100).select("source", "id", "started_at", "status", "truncated")


@query
def log_failed_described(spark: SparkSession, folder: str) -> DataFrame:
    """Failed attempts with the class of the failure."""
    failed = views.attempts(spark, folder, "status = 'failed'")
    what = failures.described_what(F.col("error_type"), F.col("http_status"), F.col("error_message"))
    return failed.select("id", failures.described_class(F.col("error_type"), F.col("error_message")).alias("category"), what.alias("what"))


@query
def log_latest_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "download_log").agg(F.max("id").alias("latest_id"))


@query
def log_status_class(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by what their HTTP status, and where it is missing their message, says."""
    failed = views.attempts(spark, folder, "status = 'failed'")
    return failed.groupBy(failures.status_class(F.col("http_status")).alias("class"), failures.failure_class(F.coalesce("error_message", F.lit(""))).alias("by_message")).agg(F.count("*").alias("attempts"))


@query
def search_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return history.search_candidates(views.deliveries(spark, folder), since="2022-02-01 00:00:00", openable=True, cap=1000).select("id", "status", "title", "started_at")


@query
def search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Best matches by kind, likeness and recency."""
    found = history.ranked(history.search_candidates(views.deliveries(spark, folder)), "Granular", 200)
    return found.select("id", "match_kind", F.round("similarity", 6).alias("similarity"), "matched_field")


# --- queue -------------------------------------------------------------------------------------


@query
def queue_claim_batch(spark: SparkSession, folder: str) -> DataFrame:
    return queue.claim_batch(views.queue_items(spark, folder), 25).select("id", "priority", "created_at")


@query
def queue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return queue.counts(views.queue_items(spark, folder))


@query
def queue_legacy_unscoped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").agg(F.count_if(F.col("project").isNull()).alias("unscoped"))


@query
def queue_list_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """All failed items in queue order."""
    return views.queue_items(spark, folder).filter("status = 'failed'").orderBy(F.desc("priority"), "created_at", "id").select("id", "priority", "created_at", "project")


@query
def queue_reset_in_progress(spark: SparkSession, folder: str) -> DataFrame:
    return queue.counts(queue.recovered(views.queue_items(spark, folder))).select("project", "status", "items")


@query
def queue_fold_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last thing the history says about every address."""
    events = views.attempts(spark, folder).select(F.col("url").alias("id"), F.col("id").alias("seq"), "status", "retry_count")
    return queue.folded(events).select(F.col("id").alias("url"), "status", "retry_count")


@query
def queue_has_active_url(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of addresses that are queued or in progress in the same project."""
    return queue.in_flight(views.attempts(spark, folder).select("id", "url", "project"), views.queue_items(spark, folder)).select("id")


@query
def new_completed_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Completed items whose creation lies after the first run's end."""
    before = table(spark, folder, "queue_items").filter("status = 'completed' AND updated_at < '2022-06-01 00:00:00'")
    return queue.newly_completed(views.queue_items(spark, folder), before).select("id")


@query
def dedup_registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items against what was downloaded: present, gone or unknown."""
    done = views.attempts(spark, folder, "status = 'success'")
    key = identifiers.dedup_key(F.col("doi"), F.col("url"))
    known = done.select(key.alias("dedup_key"), F.col("file_path").endswith(".pdf").alias("present")).filter("dedup_key IS NOT NULL").groupBy("dedup_key").agg(F.bool_or("present").alias("present"))
    none = F.lit(None).cast("string")
    items = table(spark, folder, "queue_items").select("id", identifiers.dedup_key(F.col("meta_doi"), none).alias("doi_key"), identifiers.dedup_key(none, F.col("url")).alias("url_key"))
    return queue.looked_up(items, known).select("id", "outcome")


@query
def registry_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A registry built from the successes of two runs."""
    done = views.attempts(spark, folder, "status = 'success' AND file_path IS NOT NULL").select(identifiers.dedup_key(F.col("doi"), F.col("url")).alias("dedup_key"), F.col("file_path").alias("relative_path"), F.col("started_at").alias("seen_at"))
    first = done.filter("seen_at < '2022-07-01 00:00:00'")
    return queue.upserted(first, done.filter("seen_at >= '2022-07-01 00:00:00'"))


# --- addresses and identifiers -------------------------------------------------------------------


@query
def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").groupBy(urls.domain(F.col("url")).alias("host")).agg(F.count("*").alias("items"))


@query
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").select("id", urls.canonical_url(F.col("url")).alias("canonical"))


@query
def url_origin(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "download_log").groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"))


@query
def url_extension(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "download_log").groupBy(urls.extension(F.col("url")).alias("extension"), urls.expects_binary(F.col("url")).alias("binary")).agg(F.count("*").alias("n"))


@query
def url_dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").select("id", identifiers.dedup_key(F.col("meta_doi"), F.col("url")).alias("dedup_key"))


@query
def doi_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The same DOI as parser, registry and history write it."""
    doi = F.col("meta_doi")
    return table(spark, folder, "queue_items").filter("meta_doi IS NOT NULL").select("id", identifiers.parsed_doi(doi).alias("parsed"), identifiers.registry_doi(doi).alias("registered"), identifiers.history_doi(doi).alias("logged"), identifiers.valid_doi(identifiers.parsed_doi(doi)).alias("valid"))


@query
def content_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "download_log").groupBy(urls.content_type_extension(F.col("content_type")).alias("extension")).agg(F.count("*").alias("n"))


# --- failures, retries, spacing ----------------------------------------------------------------


@query
def failure_summary(spark: SparkSession, folder: str) -> DataFrame:
    failed = views.attempts(spark, folder, "status = 'failed'")
    return failed.groupBy(failures.described_class(F.col("error_type"), F.col("error_message")).alias("category")).agg(F.count("*").alias("failures"), F.countDistinct(urls.domain(F.col("url"))).alias("domains"))


@query
def failure_auth_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that asked for a login, from their failure messages."""
    denied = views.attempts(spark, folder, "error_type = 'auth'")
    message = F.concat(F.lit("[AUTH] authentication required for "), urls.domain(F.col("url")), F.lit(" (HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("401")), F.lit(")"))
    return denied.groupBy(failures.auth_domain(message).alias("domain")).agg(F.count("*").alias("failures"))


@query
def http_status_class(spark: SparkSession, folder: str) -> DataFrame:
    log = views.attempts(spark, folder, "http_status IS NOT NULL")
    return log.groupBy("http_status", failures.status_class(F.col("http_status")).alias("class"), failures.status_error_type(F.col("http_status")).alias("error_type")).agg(F.count("*").alias("n"))


@query
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    failed = views.attempts(spark, folder, "status = 'failed'").select("id", failures.status_class(F.coalesce("http_status", F.lit(503))).alias("failure"))
    return rates.retry_schedule(failed, 6).select("id", "attempt", "delay_ms")


@query
def retry_after_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Waits of numbers, negative numbers, dates and junk."""
    k = F.col("id") % 5
    date = F.date_format(F.to_timestamp("started_at") + F.expr("INTERVAL 90 SECONDS"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(k == 0, (F.col("id") * 7).cast("string")).when(k == 1, "-5").when(k == 2, date).when(k == 3, "soon").otherwise(" 30 ")
    log = views.attempts(spark, folder).select("id", failures.retry_after_s(header, F.to_timestamp("started_at")).alias("wait_s"))
    return log


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("https://host"), F.col("user_id") % 50, F.lit(".example/x")).alias("url"), F.unix_millis("ts").alias("arrived_ms"))


@query
def rate_limit_schedule(spark: SparkSession, folder: str) -> DataFrame:
    requests = _requests(spark, folder).withColumn("domain", urls.domain(F.col("url")))
    return rates.request_schedule(requests, 60_000).select("domain", "id", "arrived_ms", "start_ms")


@query
def rate_limit_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    requests = _requests(spark, folder).withColumn("domain", urls.domain(F.col("url")))
    return rates.cumulative_wait(rates.request_schedule(requests, 600_000))


# --- pages, robots, cookies, routing -------------------------------------------------------------


@query
def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Queued addresses that the rules of their hosts allow."""
    items = table(spark, folder, "queue_items").select("id", "url")
    body = F.concat(F.lit("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /"), F.when(F.length(urls.origin(F.col("url"))) % 2 == 0, "handle").otherwise("article"), F.lit("*\nDisallow:\nAllow: /handle/x0"))
    files = items.filter(urls.origin(F.col("url")).isNotNull()).select(urls.origin(F.col("url")).alias("origin"), body.alias("body")).distinct()
    return web.allowed(items, web.robots_rules(files)).select("id")


@query
def cookie_netscape_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Cookie lines with their problems."""
    k = F.col("c_custkey") % 7
    flag = F.when(k == 1, "YES").otherwise("TRUE")
    expires = F.when(k == 2, "later").otherwise((F.col("c_custkey") * 1000).cast("string"))
    line = F.when(k == 0, F.concat(F.lit("# "), F.col("c_name"))).otherwise(F.concat_ws("\t", F.concat(F.lit(".d"), F.col("c_nationkey"), F.lit(".example")), F.lit("TRUE"), F.lit("/"), flag, expires, F.when(k == 3, "").otherwise(F.col("c_name")), F.lit("v")))
    return web.netscape_cookies(table(spark, folder, "customer").select(line.alias("line"))).groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("expires"))).alias("expires"))


@query
def cookie_domain_status(spark: SparkSession, folder: str) -> DataFrame:
    cookies = table(spark, folder, "customer").select(F.concat(F.lit(".d"), F.col("c_nationkey"), F.lit(".example")).alias("domain"), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_custkey") * 100).alias("expires"))
    return web.cookie_status(cookies, 60_000)


@query
def html_meta_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = web.meta_tags(F.col("html"))
    return views.pages(spark, folder).select("bib_id", web.first_meta(tags, "citation_title").alias("title"), web.first_meta(tags, "dc.identifier", "citation_doi").alias("doi"), F.array_join(web.all_meta(tags, "citation_author"), "|").alias("authors"))


@query
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return views.pages(spark, folder).select("bib_id", web.title(F.col("html")).alias("title"), web.pdf_link(F.col("html")).alias("pdf"))


@query
def crossref_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Work documents of the authors table: names joined, first title, year."""
    author = F.struct("given", "family")
    works = table(spark, folder, "crossref_authors").filter("work_doi IS NOT NULL").groupBy("work_doi").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "seq", "row_id", author.alias("a")))).alias("x"))
    body = F.to_json(F.struct(F.struct(F.col("work_doi").alias("DOI"), F.array(F.concat(F.lit("Work "), F.col("work_doi")), F.lit("other")).alias("title"), F.transform("x", lambda e: e["a"]).alias("author"), F.struct(F.array(F.array(F.lit(2001), F.lit(5))).alias("date-parts")).alias("published")).alias("message")))
    parsed = works.select(F.from_json(body, "struct<message:struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>>>")["message"].alias("m"))
    names = F.array_join(F.transform("m.author", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")
    return parsed.select(F.col("m.DOI").alias("doi"), F.try_element_at("m.title", F.lit(1)).alias("title"), names.alias("authors"), F.col("m.published.date-parts")[0][0].cast("string").alias("year"))


@query
def crossref_pdf_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The link a work's response offers, by type and intended use."""
    k = F.col("p_partkey") % 4
    link = lambda name, kind, use: F.struct(F.lit(f"https://x.example/{name}").alias("URL"), kind.alias("content-type"), use.alias("intended-application"))
    none = F.lit(None).cast("string")
    links = F.array(link("a", none, F.when(k != 3, "Text-Mining")), link("b", F.when(k == 0, "application/pdf; v=1"), none), link("c", F.lit("text/html"), F.when(k <= 1, "similarity-checking")))
    parsed = F.from_json(F.to_json(links), metadata.LINK_DDL)
    return table(spark, folder, "part").select("p_partkey", metadata.best_link(parsed).alias("pdf"))


@query
def open_pdf_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Open copy, preprint or publisher."""
    k = F.col("p_partkey") % 5
    found = F.when(k == 0, "https://repo.example/x").when(k == 1, "https://doi.org/10.1/x").when(k == 2, "https://a.acm.org/x").when(k == 3, "http://repo.example/x")
    return table(spark, folder, "part").select("p_partkey", metadata.best_open_pdf(found, F.when(k == 2, "2101.00001").otherwise(""), F.lit("https://publisher.example/p"), ["acm.org"]).alias("pdf"))


@query
def mdpi_store_url(spark: SparkSession, folder: str) -> DataFrame:
    """File-store addresses from DOIs with padded and plain issue numbers."""
    volume, issue = (F.col("p_partkey") % 30 + 1).cast("string"), (F.col("p_partkey") % 12 + 1).cast("string")
    padded = F.when(F.col("p_partkey") % 2 == 0, F.lpad(issue, 2, "0")).otherwise(issue)
    doi = F.concat(F.lit("10.3390/Electronics"), volume, padded, F.lit("9"), F.col("p_partkey"))
    slug = metadata.journal_slug(doi)
    number = metadata.article_number(doi, slug, volume, padded)
    return table(spark, folder, "part").select("p_partkey", metadata.store_url(slug, volume, number).alias("url"))


@query
def cookie_headers(spark: SparkSession, folder: str) -> DataFrame:
    secure, domain = F.col("c_custkey") % 2 == 0, F.concat(F.lit(".d"), F.col("c_nationkey"), F.lit(".example"))
    header = metadata.set_cookie(F.col("c_name"), F.lit("v"), domain, F.lit("/p"), secure, (F.col("c_custkey") % 3) * 86_400_000)
    return table(spark, folder, "customer").select("c_custkey", header.alias("header"), metadata.cookie_origin(domain, F.lit("/p"), secure).alias("origin"))


def _routable(spark: SparkSession, folder: str) -> DataFrame:
    """Items of all kinds: DOIs and addresses re-rendered for every source by id."""
    prefixes = ["10.1109/", "10.1093/", "10.1007/", "10.1016/", "10.1145/", "10.1002/", "10.1111/", "10.3390/", "10.48550/arXiv.2101.0", "10.5555/"]
    pages = ["https://arxiv.org/abs/2101.0", "https://ieeexplore.ieee.org/document/", "https://academic.oup.com/j/article/", "https://link.springer.com/article/", "https://www.sciencedirect.com/science/article/pii/S00000000", "https://dl.acm.org/doi/10.1145/", "https://onlinelibrary.wiley.com/doi/10.1002/", "https://www.mdpi.com/1234-5678/1/2/", "https://youtu.be/v", "https://pmc.ncbi.nlm.nih.gov/articles/PMC1"]
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("p_partkey") % len(options) + 1).cast("int"))
    number = F.lpad((F.col("p_partkey") % 1000 + 1000).cast("string"), 4, "0")
    parts = table(spark, folder, "part")
    doi = parts.select((F.col("p_partkey") * 3).alias("id"), F.lit("doi").alias("kind"), F.concat(pick(prefixes), number).alias("value"))
    page = parts.select((F.col("p_partkey") * 3 + 1).alias("id"), F.lit("url").alias("kind"), F.concat(pick(pages), number).alias("value"))
    other = parts.select((F.col("p_partkey") * 3 + 2).alias("id"), pick(["unknown", "reference", "bibtex"]).alias("kind"), F.concat(F.lit("PMC"), number).alias("value"))
    return doi.unionByName(page).unionByName(other)


@query
def resolver_route(spark: SparkSession, folder: str) -> DataFrame:
    return _routable(spark, folder).select("id", routing.route(F.col("value"), F.col("kind")).alias("rule"))


@query
def queue_route(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items by the rule that would resolve them."""
    kind = F.when(F.col("source_type") == "direct_url", "url").when(F.col("source_type") == "doi", "doi").otherwise(F.col("source_type"))
    items = table(spark, folder, "queue_items").select(kind.alias("kind"), F.when(kind == "url", F.col("url")).otherwise(F.coalesce("original_input", "url")).alias("value"))
    return items.groupBy("kind", routing.route(F.col("value"), F.col("kind")).alias("rule")).agg(F.count("*").alias("items"))


@query
def resolver_redirect_chase(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of up to eight redirects followed to their end."""
    at = lambda n: F.concat(F.lit("https://r.example/"), n)
    parts = table(spark, folder, "part").select("p_partkey")
    redirects = parts.filter("p_partkey % 8 != 0").select(at(F.col("p_partkey")).alias("url"), at(F.col("p_partkey") - 1).alias("target"))
    return routing.chased(parts.select("p_partkey", at(F.col("p_partkey")).alias("url")), redirects).select("p_partkey", "final_url", "hops")


# --- texts -------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").select(F.col("id").alias("input_id"), F.col("original_input").alias("text"))


@query
def parse_items_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Items of what users typed, in the order of the contract."""
    return parsing.parsed_items(_inputs(spark, folder))


@query
def parse_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """What is set apart of raw records and documents read as running text, by its kind."""
    raw = table(spark, folder, "raw_records").select(F.col("record_id").alias("input_id"), F.col("raw").alias("text"))
    found = parsing.skipped_parts(raw.unionByName(table(spark, folder, "documents").select(F.col("doc_id").alias("input_id"), "text")))
    return found.groupBy(F.regexp_extract("message", r"^(What: [a-z]+ BibTeX|unparseable reference|10\.|https?:)", 1).alias("what")).agg(F.count("*").alias("n"))


@query
def parse_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.type_counts(parsing.parsed_items(_inputs(spark, folder)))


def _mixed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with one address and one DOI each, wrapped in punctuation."""
    n = F.col("p_partkey")
    text = F.concat(F.lit("See (https://H.example:443/a_("), n, F.lit(")), then doi:10.5555/Part("), n, F.lit(")). End."))
    return table(spark, folder, "part").select(n.alias("input_id"), text.alias("text"))


@query
def parse_urls(spark: SparkSession, folder: str) -> DataFrame:
    found = parsing.parsed_items(_mixed_texts(spark, folder))
    return found.filter("kind = 'url'").select("input_id", "value")


@query
def parse_dois(spark: SparkSession, folder: str) -> DataFrame:
    found = parsing.parsed_items(_mixed_texts(spark, folder))
    return found.filter("kind = 'doi'").select("input_id", "ord", "value")


@query
def parse_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One line on the references of the customers and the items of the parts."""
    items = parsing.type_counts(parsing.parsed_items(_mixed_texts(spark, folder)))
    levels = parsing.references(_citations(spark, folder)).agg(*[F.count_if(F.col("confidence") == k).alias(k) for k in ("high", "medium", "low")])
    both = items.unionByName(levels, allowMissingColumns=True)  # one row each
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    counts = {"url": F.col("url_items"), "doi": F.col("doi_items"), "reference": F.col("high") + F.col("medium") + F.col("low"), "bibtex": F.col("bibtex_items")}
    return both.select(metadata.parse_summary(counts, {k: F.col(k) for k in ("high", "medium", "low")}).alias("summary"))


@query
def parse_known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers that are whole lines, in normal form."""
    k = F.col("p_partkey") % 6
    n = F.lpad((F.col("p_partkey") + 10_000).cast("string"), 5, "0")
    line = F.when(k == 0, F.concat(F.lit(" pmc"), n)).when(k == 1, F.concat(F.lit("2101."), n)).when(k == 2, F.concat(F.lit("arXiv: 2101."), n, F.lit("v2"))).when(k == 3, F.concat(F.lit("PMID "), n)).when(k == 4, F.concat(F.lit("PMID"), n)).otherwise(F.concat(F.lit("see PMC"), n))
    return table(spark, folder, "part").select("p_partkey", identifiers.known_id(line).alias("known"))


def _citations(spark: SparkSession, folder: str) -> DataFrame:
    """References rendered from customers and parts; every third lacks a part."""
    k = F.col("c_custkey") % 4
    author = F.when(k == 1, "").otherwise(F.concat(F.lit("Smith, J., ")))
    year = F.when(k == 2, "").otherwise(F.concat(F.lit("("), F.lit(1900) + F.col("c_custkey") % 120, F.lit(") ")))
    text = F.concat(author, year, F.lit("Report on segment "), F.lower("c_mktsegment"), F.lit(" no "), F.col("c_custkey") % 10, F.lit(". Journal of Segments."))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("input_id"), text.alias("text"))


@query
def reference_confidence(spark: SparkSession, folder: str) -> DataFrame:
    found = parsing.references(_citations(spark, folder))
    return found.select("input_id", F.array_join("authors", "|").alias("authors"), "year", "confidence")


@query
def confidence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.references(_citations(spark, folder)).groupBy("confidence").agg(F.count("*").alias("n"))


def _bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """Bibliographies of numbered lines, wrapped lines and blocks, one per customer."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Further reading:\n[1] Smith, J. (2001). First of "), F.col("c_name"), F.lit(".\nPress.\n2) Jones, K. (2002). Second, a journal.\n\nLiterature\nBrown, L. (2003). Third "), k, F.lit("\nwrapped line.\nGreen, M. (2004). Fourth. End.\n---\n12.\n3. too short\n4. foo, bar, baz, qux, quux, corge"))
    return table(spark, folder, "customer").select(k.cast("bigint").alias("input_id"), text.alias("text"))


@query
def bibliography_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of bibliographies that look like references."""
    return parsing.bibliography_entries(_bibliographies(spark, folder))


@query
def bibliography_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many references were found, accepted and left uncertain."""
    return parsing.bibliography_summary(parsing.bibliographies(_bibliographies(spark, folder)))


@query
def bibliography_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The references in the documents, with what was found in each."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("input_id"), "text")
    return parsing.bibliographies(texts).select("input_id", "entry_no", "entry", F.array_join("authors", "|").alias("authors"), "year", "title", "confidence", "accepted")


@query
def ris_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The raw RIS records parsed back into the columns they were written from."""
    raw = table(spark, folder, "ris_entries").select(F.col("ris_id").alias("input_id"), F.col("raw").alias("text"))
    found = parsing.ris_entries(parsing.ris_records(raw))
    return found.select(F.col("input_id").alias("ris_id"), "entry_type", F.trim("title").alias("title"), F.array_join("authors", "|").alias("authors"), "year", "doi", "url", "problem")


@query
def ris_items(spark: SparkSession, folder: str) -> DataFrame:
    """What a RIS import makes of the records: DOI or address, and reference."""
    raw = table(spark, folder, "ris_entries").select(F.col("ris_id").alias("input_id"), F.col("raw").alias("text"))
    return parsing.ris_items(parsing.ris_entries(parsing.ris_records(raw))).select(F.col("input_id").alias("ris_id"), "ord", "kind", "value")


@query
def bibtex_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The raw BibTeX entries parsed back into the columns they were written from."""
    raw = table(spark, folder, "bibtex_entries").select(F.col("bib_id").alias("input_id"), F.col("raw").alias("text"))
    return parsing.bibtex_entries(raw).select(F.col("input_id").alias("bib_id"), "entry_type", "key", F.trim("title").alias("title"), "authors", "year", "doi", "problem")


@query
def md_links_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses in the documents, each where it is seen first."""
    return parsing.markdown_links(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "url")


@query
def topics_normalize(spark: SparkSession, folder: str) -> DataFrame:
    found = topics.normal_topics(topics.stored_topics(F.col("topics")))
    return table(spark, folder, "queue_metadata").select("meta_id", F.array_join(found, "|").alias("topics"))


@query
def topics_match_custom(spark: SparkSession, folder: str) -> DataFrame:
    custom = F.array(F.lit("Frost"), F.lit("tidal"), F.lit("the cable hum of masts"))
    found = topics.custom_first(topics.stored_topics(F.col("topics")), custom)
    return table(spark, folder, "queue_metadata").select("meta_id", F.array_join(found, "|").alias("topics"))


@query
def topics_rake(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of every document."""
    return topics.rake(table(spark, folder, "documents"))


# --- names and reports ---------------------------------------------------------------------------


@query
def filename_preferred(spark: SparkSession, folder: str) -> DataFrame:
    name = naming.preferred_filename(F.col("url"), F.col("authors"), F.lit("2020"), F.col("title"), F.lit(EPOCH))
    return views.attempts(spark, folder, "status = 'success'").select("id", name.alias("filename"))


@query
def filename_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Suggested names numbered where they repeat within a project."""
    named = table(spark, folder, "queue_items").filter("suggested_filename IS NOT NULL").select("id", F.coalesce("project", F.lit("")).alias("project"), "suggested_filename")
    return unique_names(named, "project", "suggested_filename", "id").select("id", F.col("unique_name").alias("filename"))


@query
def project_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat(F.col("label"), F.when(F.length("project") % 2 == 0, " / aux?").otherwise("/con"))
    return table(spark, folder, "projects").select("project", naming.project_name(label).alias("name"), naming.project_folder(label).alias("folder"))


@query
def export_bibtex(spark: SparkSession, folder: str) -> DataFrame:
    return exports.bibtex_entries(views.corpus(spark, folder)).select("path", "entry")


@query
def export_ris(spark: SparkSession, folder: str) -> DataFrame:
    return exports.ris_records(views.corpus(spark, folder)).select("path", "entry")


@query
def sidecar_json(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecar documents of the completed items."""
    return exports.sidecars(views.queue_items(spark, folder))


@query
def sidecar_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """What a corpus scan reads back from them."""
    documents = exports.sidecars(views.queue_items(spark, folder)).select(F.concat(F.lit("c/"), F.col("id"), F.lit(".json")).alias("path"), "document")
    return exports.read_sidecars(documents).select("path", "title", F.size("authors").alias("authors"), "date", "doi", "url")


@query
def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    return exports.index_rows(views.queue_items(spark, folder))


@query
def download_log_rows(spark: SparkSession, folder: str) -> DataFrame:
    return exports.log_rows(views.attempts(spark, folder))


@query
def project_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct topics of every project's completed items."""
    each = views.queue_items(spark, folder).filter("status = 'completed'").select("project", F.explode(topics.normal_topics(topics.stored_topics(F.col("topics")))).alias("topic"))
    return each.distinct().groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("topics"))


@query
def convert_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Downloaded pages by what a conversion would do: skipped beside a PDF or of a host that gives none, else converted.

    Pages, PDFs and sidecars are met by the path without its ending; the sidecar names the host.
    """
    skipped = ["archive.slowmaterials.example", "tides.example"]
    log = views.attempts(spark, folder, "status = 'success'").withColumn("stem", F.regexp_replace("file_path", r"\.[^./]*$", ""))
    pages = log.filter("content_type = 'text/html' OR content_type = 'application/octet-stream'").select("id", "stem")
    cards = views.queue_items(spark, folder).filter("status = 'completed' AND saved_path IS NOT NULL").select(F.regexp_replace("saved_path", r"\.[^./]*$", "").alias("stem"), "url")
    return exports.conversion_plan(pages, log.filter("content_type = 'application/pdf'").select("stem"), cards, skipped).select("id", "action")


# --- streams -----------------------------------------------------------------------------------


@query
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind, as the watermark closes the days."""
    return jobs.drained(jobs.progress(jobs.table_stream(spark, folder, "events"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def stream_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Events per kind, as the last of the snapshots tells."""
    return jobs.snapshots(jobs.table_stream(spark, folder, "events"))


@query
def stream_rules_read(spark: SparkSession, folder: str) -> DataFrame:
    """The requests at which the rules of an origin are read anew."""
    stream = jobs.table_stream(spark, folder, "events")
    requests = stream.select(F.col("event_id").alias("id"), F.concat(F.lit("https://host"), F.col("user_id") % 50, F.lit(".example/x")).alias("url"), F.unix_millis("ts").alias("at_ms"))
    return jobs.drained(jobs.rules_to_read(requests, ends=False))


@query
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The users seen in the stream, each once."""
    return jobs.drained(jobs.first_sights(jobs.table_stream(spark, folder, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"])).select("user_id", "event_type")


@query
def stream_rate_limiter(spark: SparkSession, folder: str) -> DataFrame:
    """The stateful form of ``rate_limit_schedule``; gives the same rows."""
    stream = jobs.table_stream(spark, folder, "events")
    requests = stream.select(F.col("event_id").alias("id"), F.concat(F.lit("https://host"), F.col("user_id") % 50, F.lit(".example/x")).alias("url"), F.unix_millis("ts").alias("arrived_ms"))
    return jobs.drained(jobs.spaced_requests(requests, 60_000, None)).select("domain", "id", "arrived_ms", "start_ms")
