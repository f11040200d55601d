"""Queries on addresses, identifiers, pages, cookies, service responses and inputs, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import identifiers, metadata, urls
from stackmill.operators import parsing, routing, web
from stackmill.operators import topics as topic
from stackmill.plans import views
from stackmill.plans.catalog_sql import LOG, canonical, extension, host, path, stripped
from stackmill.sources.files import joined_input, merged_input, values_of_items
from stackmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EPOCH = 1_700_000_000
NOW_S = 60_000


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pick(column: str, *options: str) -> Column:
    """One of the texts for each row, in turn by an integer column."""
    return F.element_at(F.array(*map(F.lit, options)), (F.col(column) % len(options) + 1).cast("int"))


def _pick_sql(column: str, *options: str) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"][CAST({column} % {len(options)} AS INT) + 1]"


# --- addresses -----------------------------------------------------------------------------------

_FINAL = "coalesce(final_url, url) || CASE WHEN error_type = 'auth' THEN '/SignIn?x=1' WHEN id % 5 = 0 THEN '/sso' ELSE '' END"
_TYPE = "CASE WHEN id % 2 = 0 THEN 'Text/HTML; charset=utf-8' ELSE coalesce(content_type, '') END"


@query(f"SELECT id, CASE WHEN regexp_matches(lower({path('url')}), '\\.(pdf|docx?|epub|zip|gz|xlsx?|pptx?|od[tsp]|rtf|ps|djvu|mobi)$') AND contains(lower(t), 'text/html') AND regexp_matches(lower(f), '/signin|/sso|/login|/sign-in|/auth/|/saml|/oauth|/openid|/idp/') THEN coalesce({host('f')}, {host('url')}, 'unknown') END AS login FROM (SELECT id, url, {_FINAL} AS f, {_TYPE} AS t FROM {LOG})")
def url_login_redirect(spark: SparkSession, folder: str) -> DataFrame:
    """Downloads that ended at a login page instead of a file."""
    log = views.attempts(spark, folder)
    return log.select("id", urls.login_domain(F.col("url"), F.expr(_TYPE), F.expr(_FINAL)).alias("login"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'https://p.example/doi/' || CASE WHEN id % 3 = 0 THEN 'abs/' ELSE '' END || id END AS referer, '{EPOCH}' AS epoch, CASE WHEN {path('url')} LIKE '%/' THEN 'download_{EPOCH}.bin' WHEN regexp_matches({path('url')}, '/\\.\\.?$') THEN repeat('_', length({path('url')}) - length(regexp_replace({path('url')}, '\\.+$', ''))) ELSE regexp_replace(regexp_extract({path('url')}, '([^/]*)$', 1), '[/\\\\:*?\"<>|]', '_', 'g') END AS fallback FROM queue_items WHERE url IS NOT NULL")
def url_names(spark: SparkSession, folder: str) -> DataFrame:
    """Landing pages of direct links, and names of files from addresses alone."""
    k = F.col("id")
    link = F.when(k % 2 == 0, F.concat(F.lit("https://P.example:443/doi/pdf/"), F.when(k % 3 == 0, "abs/").otherwise(""), k, F.lit("?download=true"))).otherwise(F.concat(F.lit("https://p.example/pdf/doi/pdf/"), k))
    items = table(spark, folder, "queue_items").filter("url IS NOT NULL")
    return items.select("id", urls.referer(link).alias("referer"), F.lit(str(EPOCH)).alias("epoch"), urls.fallback_filename(F.col("url"), F.lit(EPOCH)).alias("fallback"))


_LINKS = ("https://o.example/x", "//c.example/y", "/root.pdf", "same.pdf?x=1#y", "../up.pdf", "./a/./b/../c.pdf", "?q=1", "#top", "../../../../far.pdf", "sub/")
_JOINED = "CASE CAST(id % 10 AS INT) WHEN 0 THEN 'https://o.example/x' WHEN 1 THEN 'https://c.example/y' WHEN 2 THEN o || '/root.pdf' WHEN 3 THEN o || '/j/' || id || '/same.pdf?x=1#y' WHEN 4 THEN o || '/j/up.pdf' WHEN 5 THEN o || '/j/' || id || '/a/c.pdf' WHEN 6 THEN o || '/j/' || id || '/page?q=1' WHEN 7 THEN o || '/j/' || id || '/page?v=2#top' WHEN 8 THEN o || '/far.pdf' ELSE o || '/j/' || id || '/sub/' END"


@query(f"SELECT id, {_JOINED} AS url FROM (SELECT id, 'https://base.example' AS o FROM queue_items)")
def url_absolute(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every form joined to the pages they stand on."""
    base = F.concat(F.lit("https://Base.example/j/"), F.col("id"), F.lit("/page?v=2#old"))
    return table(spark, folder, "queue_items").select("id", urls.absolute(_pick("id", *_LINKS), base).alias("url"))


@query(f"SELECT q.id, coalesce(lower(regexp_replace(regexp_replace(trim({host('url')}), '^(www\\.)+', ''), '\\.+$', '')) = lower(regexp_replace(regexp_replace(trim(coalesce({host('url')}, url)), '^(www\\.)+', ''), '\\.+$', '')), false) AS same, length(url) <= 2000 AND {host('url')} IS NOT NULL AS valid FROM queue_items q WHERE url IS NOT NULL")
def url_hosts_match(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts met in other forms, and whether addresses are valid."""
    other = F.concat(F.lit("HTTPS://WWW."), urls.host(F.col("url")), F.lit("/elsewhere"))
    items = table(spark, folder, "queue_items").filter("url IS NOT NULL")
    return items.select("id", F.coalesce(urls.hosts_match(F.col("url"), other), F.lit(False)).alias("same"), urls.valid_url(F.col("url")).alias("valid"))


_HEADERS = ('attachment; filename="a b.pdf"', "attachment; filename=plain.pdf; size=3", "attachment; filename*=UTF-8''na%C3%AFve%20x.pdf; filename=other.pdf", "inline", 'attachment; filename="open.pdf', "attachment; filename= spaced.pdf ")


@query("SELECT p_partkey, ['a b.pdf', 'plain.pdf', 'naïve x.pdf', NULL, NULL, 'spaced.pdf'][CAST(p_partkey % 6 AS INT) + 1] AS name FROM part")
def disposition_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of response headers in every form."""
    return table(spark, folder, "part").select("p_partkey", urls.disposition_filename(_pick("p_partkey", *_HEADERS)).alias("name"))


# --- identifiers ---------------------------------------------------------------------------------

_PAGES = ("https://pmc.ncbi.nlm.nih.gov/articles/pmc{0}/pdf", "https://pubmed.ncbi.nlm.nih.gov/{0}/", "https://ieeexplore.ieee.org/document/{0}", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&ARNUMBER={0}", "https://link.springer.com/content/pdf/10.1007/s{0}-x.pdf", "https://link.springer.com/article/10.1007/s{0}", "https://www.sciencedirect.com/science/article/abs/pii/S00{0}", "https://x.example/{0}a/")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'PMC' || n END AS pmcid, CASE WHEN p_partkey % 8 IN (1, 2) THEN n END AS pmid, CASE WHEN p_partkey % 8 IN (2, 3) THEN n END AS ieee, CASE p_partkey % 8 WHEN 4 THEN '10.1007/s' || n || '-x' WHEN 5 THEN '10.1007/s' || n END AS springer, CASE p_partkey % 8 WHEN 6 THEN 'S00' || n END AS pii, CASE p_partkey % 3 WHEN 0 THEN '10.1093/x' || n WHEN 1 THEN '10.1093/y' ELSE 'doi 10.1093' END AS stated FROM (SELECT p_partkey, lpad(CAST(p_partkey + 1000000 AS VARCHAR), 8, '0') AS n FROM part)")
def publisher_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers in addresses of publishers' pages, and DOIs as pages state them."""
    n = F.lpad((F.col("p_partkey") + 1_000_000).cast("string"), 8, "0")
    url = F.replace(_pick("p_partkey", *_PAGES), F.lit("{0}"), n)
    at = F.col("p_partkey") % 8
    stated = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" DOI: 10.1093/x"), n)).when(F.col("p_partkey") % 3 == 1, "10.1093/y ").otherwise("doi 10.1093")
    rows = table(spark, folder, "part").select("p_partkey", url.alias("u"), stated.alias("s"), at.alias("at"))
    ieee = F.when(F.col("at").isin(2, 3), identifiers.ieee_number(F.col("u")))
    return rows.select("p_partkey", identifiers.pmcid(F.col("u")).alias("pmcid"), identifiers.pmid(F.col("u")).alias("pmid"), ieee.alias("ieee"), identifiers.springer_doi(F.col("u")).alias("springer"), identifiers.pii(F.col("u")).alias("pii"), identifiers.meta_doi(F.col("s")).alias("stated"))


@query("SELECT id, meta_doi AS d, lower(trim(meta_doi)) LIKE '10.5555/%' OR lower(trim(meta_doi)) LIKE '10.90001/%' AS own FROM queue_items WHERE meta_doi IS NOT NULL")
def doi_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs by the prefix of their publisher."""
    items = table(spark, folder, "queue_items").filter("meta_doi IS NOT NULL")
    return items.select("id", F.col("meta_doi").alias("d"), identifiers.has_doi_prefix(F.trim("meta_doi"), "10.5555/", "10.90001/").alias("own"))


# --- routing -------------------------------------------------------------------------------------


@query("SELECT k AS kind, CASE WHEN k = 'url' AND url IS NOT NULL THEN 'url' WHEN k = 'doi' THEN 'all_failed' ELSE 'no_resolver' END AS step, CASE WHEN k = 'url' AND url IS NOT NULL THEN 'direct' END AS rule, count(*) AS items FROM (SELECT CASE source_type WHEN 'direct_url' THEN 'url' ELSE source_type END AS k, url FROM queue_items) GROUP BY 1, 2, 3")
def queue_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items by what the rules make of them without asking a service."""
    kind = F.when(F.col("source_type") == "direct_url", "url").otherwise(F.col("source_type"))
    items = table(spark, folder, "queue_items").select(kind.alias("kind"), F.when(kind == "url", F.col("url")).otherwise(F.coalesce("original_input", "url")).alias("value"))
    rows = items.withColumn("r", routing.resolved(F.col("value"), F.col("kind")))
    return rows.groupBy("kind", F.col("r.step").alias("step"), F.col("r.rule").alias("rule")).agg(F.count("*").alias("items"))


@query("SELECT k AS kind, CASE WHEN k = 'url' AND url IS NOT NULL THEN 'direct' WHEN k = 'doi' THEN 'crossref' ELSE '' END AS names, count(*) AS items FROM (SELECT CASE source_type WHEN 'direct_url' THEN 'url' ELSE source_type END AS k, url FROM queue_items) GROUP BY 1, 2")
def queue_handlers(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items by all rules that would take them."""
    kind = F.when(F.col("source_type") == "direct_url", "url").otherwise(F.col("source_type"))
    items = table(spark, folder, "queue_items").select(kind.alias("kind"), F.when(kind == "url", F.col("url")).otherwise(F.coalesce("original_input", "url")).alias("value"))
    return items.groupBy("kind", F.array_join(routing.handlers(F.col("value"), F.col("kind")), "|").alias("names")).agg(F.count("*").alias("items"))


# --- pages ---------------------------------------------------------------------------------------


@query(f"SELECT bib_id, nullif({stripped('title')}, '') AS title, CASE WHEN key = entry_type THEN key ELSE key || '; ' || entry_type END AS authors, coalesce(doi, 'none') AS doi, CASE WHEN year BETWEEN 1900 AND 2099 THEN CAST(year AS VARCHAR) END AS year FROM bibtex_entries")
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What pages state of their works."""
    found = views.pages(spark, folder).select("bib_id", web.work_metadata(F.col("html")).alias("m"))
    return found.select("bib_id", "m.title", "m.authors", "m.doi", "m.year")


_BODY = '<p>{1}</p><a href="{0}">PDF</a><script>{2}</script>'


def _publisher_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of publishers by key: a tag, a link or a field that gives the PDF, or none of them."""
    n = F.col("p_partkey")
    tag = F.when(n % 3 == 0, F.concat(F.lit('<meta name="citation_pdf_url" content="/tag/'), n, F.lit('.pdf">'))).otherwise("")
    link = F.when(n % 3 == 1, F.concat(F.lit('<a href="/content/pdf/'), n, F.lit(".pdf?x\">a</a><a href='/x/article-pdf/"), n, F.lit("'>b</a><i>/stamp/stamp.jsp?arnumber="), n, F.lit('</i>"pdfUrl":"\\u002Fp\\/'), n, F.lit('.pdf"'))).otherwise("")
    text = _pick("p_partkey", "Sign in. Purchase PDF. Buy article.", "You do not currently have access to this article", "An open article. Subscribe.", "Shibboleth, single sign-on, institutional access: Access through your institution", "see id.elsevier.com")
    page = F.concat(F.lit("https://"), F.lit("h.example/science/article/pii/S"), F.lpad(n.cast("string"), 10, "0"), F.when(n % 7 == 0, "/login").otherwise(""))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.lit("<html>"), tag, link, text, F.lit("</html>")).alias("html"), page.alias("page"))


_AT = "'https://h.example'"


@query(f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_AT} || '/tag/' || p_partkey || '.pdf' WHEN 1 THEN {_AT} || '/content/pdf/' || p_partkey || '.pdf?x' END AS springer, CASE p_partkey % 3 WHEN 0 THEN {_AT} || '/tag/' || p_partkey || '.pdf' WHEN 1 THEN {_AT} || '/x/article-pdf/' || p_partkey END AS oxford, CASE p_partkey % 3 WHEN 0 THEN {_AT} || '/tag/' || p_partkey || '.pdf' WHEN 1 THEN {_AT} || '/stamp/stamp.jsp?arnumber=' || p_partkey || '</i>' END AS ieee, CASE p_partkey % 3 WHEN 0 THEN {_AT} || '/tag/' || p_partkey || '.pdf' WHEN 1 THEN {_AT} || '/content/pdf/' || p_partkey || '.pdf?x' END AS pubmed, CASE p_partkey % 3 WHEN 0 THEN {_AT} || '/tag/' || p_partkey || '.pdf' WHEN 1 THEN {_AT} || '/p/' || p_partkey || '.pdf' ELSE 'https://www.sciencedirect.com/science/article/pii/S' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '/pdfft?isDTMRedir=true&download=true' END AS sciencedirect FROM part")
def publisher_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """The PDFs that pages offer, as each publisher's form is read."""
    names = ["springer", "oxford", "ieee", "pubmed", "sciencedirect"]
    return _publisher_pages(spark, folder).select("p_partkey", *[web.publisher_pdf(F.col("html"), F.col("page"), n).alias(n) for n in names])


@query("SELECT p_partkey, p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS ieee, p_partkey % 5 IN (0, 1) OR p_partkey % 7 = 0 AS oxford, p_partkey % 5 = 0 AS springer, p_partkey % 5 IN (3, 4) AS sciencedirect FROM part")
def page_walls(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that ask for a login or a purchase, as each publisher's are told."""
    return _publisher_pages(spark, folder).select("p_partkey", *[web.wall(F.col("html"), F.col("page"), n).alias(n) for n in web.WALLS])


@query("SELECT origin, '/a/longest-|/b/longer|/c' AS prefixes FROM (SELECT DISTINCT 'https://h' || n_nationkey || '.example' AS origin FROM nation)")
def robots_longest_first(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of every origin, the longest first."""
    body = F.lit("User-agent: *\nDisallow: /c\nDisallow: a/longest-*\nDisallow: /b/longer\nDisallow: /c*\n\nDisallow: *\nDisallow:")
    files = table(spark, folder, "nation").select(F.concat(F.lit("https://h"), F.col("n_nationkey"), F.lit(".example")).alias("origin"), body.alias("body"))
    return web.longest_first(web.robots_rules(files).filter("prefix != '/'")).select("origin", F.array_join("prefixes", "|").alias("prefixes"))


# --- cookies -------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS m FROM customer) SELECT CASE WHEN m IN (4, 5) THEN 'netscape' ELSE 'json' END AS format, CASE m WHEN 1 THEN 'no value' WHEN 2 THEN 'no domain' WHEN 4 THEN CASE WHEN k * 7 > {NOW_S} THEN NULL ELSE 'expired' END WHEN 5 THEN 'not seven fields' ELSE CASE WHEN m = 0 OR k * 3 > {NOW_S} THEN NULL ELSE 'expired' END END AS problem, count(*) AS n, count(DISTINCT CASE WHEN m = 2 THEN '.' WHEN m = 5 THEN 'broken' WHEN m = 3 THEN 'h' || k % 10 || '.example' ELSE '.d' || k % 10 || '.example' END) AS domains FROM c GROUP BY 1, 2")
def cookie_capture(spark: SparkSession, folder: str) -> DataFrame:
    """Captured cookies of either form with what is wrong with them."""
    k = F.col("c_custkey")
    m = k % 6
    domain = F.when(m == 2, "").when(m == 3, F.concat(F.lit("https://h"), k % 10, F.lit(".example/x"))).otherwise(F.concat(F.lit(".d"), k % 10, F.lit(".example")))
    one = F.to_json(F.struct(domain.alias("domain"), F.when(m == 3, F.lit(True)).alias("hostOnly"), F.lit("n").alias("name"), F.when(m == 1, "").otherwise("v").alias("value"), F.when(m == 0, F.lit(0.0)).otherwise((k * 3 + 0.5).cast("double")).alias("expirationDate")))
    line = F.when(m == 5, "broken\tline").otherwise(F.concat_ws("\t", domain, F.lit("TRUE"), F.lit(""), F.lit("FALSE"), (k * 7).cast("string"), F.lit("n"), F.lit("v")))
    text = F.when(m == 0, F.concat(F.lit("  ["), one, F.lit("]"))).when(m < 4, F.concat(F.lit('{"cookies":['), one, F.lit("]}"))).otherwise(F.concat(F.lit("# head\n\n"), line, F.lit("\r\n")))
    found = web.captured_cookies(table(spark, folder, "customer").select(k.alias("capture"), text.alias("text")), NOW_S)
    return found.groupBy("format", "problem").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@query("SELECT count(DISTINCT 'd' || c_nationkey || '.example') AS domains FROM customer")
def cookie_domains(spark: SparkSession, folder: str) -> DataFrame:
    return web.domain_count(table(spark, folder, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, ".").otherwise(""), F.lit("d"), F.col("c_nationkey"), F.lit(".example")).alias("domain")))


# --- service responses ---------------------------------------------------------------------------


@query("SELECT work_doi AS doi, 'Work ' || work_doi AS title, nullif(string_agg(nullif(concat_ws(', ', family, given), ''), '; ' ORDER BY fetched_at, seq, row_id), '') AS authors, CASE length(work_doi) % 4 WHEN 0 THEN '2001' WHEN 1 THEN '2002' WHEN 2 THEN '2003' END AS year FROM crossref_authors WHERE work_doi IS NOT NULL GROUP BY 1")
def work_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Work documents of the authors table: names joined, first title, year from whichever date there is."""
    author = F.struct("given", "family")
    works = table(spark, folder, "crossref_authors").filter("work_doi IS NOT NULL").groupBy("work_doi").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "seq", "row_id", author.alias("a")))).alias("x"))
    k = F.length("work_doi") % 4
    date = lambda on, year: F.when(k == on, F.struct(F.array(F.array(F.lit(year), F.lit(5))).alias("date-parts")))
    body = F.to_json(F.struct(F.struct(F.col("work_doi").alias("DOI"), F.array(F.concat(F.lit("Work "), F.col("work_doi")), F.lit("other")).alias("title"), F.transform("x", lambda e: e["a"]).alias("author"), date(0, 2001).alias("published"), date(1, 2002).alias("published-print"), date(2, 2003).alias("published-online")).alias("message")))
    parsed = works.select(F.from_json(body, metadata.WORK_DDL)["message"].alias("m"))
    return parsed.select(F.col("m.DOI").alias("doi"), F.try_element_at("m.title", F.lit(1)).alias("title"), metadata.work_names(F.col("m.author")).alias("authors"), metadata.work_year(F.col("m")).alias("year"))


@query("SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN ['s'] WHEN 1 THEN ['sensors'] WHEN 2 THEN ['appliedsciences', 's', 'applsci'] ELSE ['marinedrugs', 's'] END, '|') AS slugs FROM part")
def journal_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Names a journal may have in the file store, in the order to try them."""
    title = F.when(F.col("p_partkey") % 4 > 0, F.element_at(F.array(F.lit("Sensors"), F.lit("Applied Sciences"), F.lit("Marine Drugs")), (F.col("p_partkey") % 4).cast("int") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)))
    return table(spark, folder, "part").select("p_partkey", F.array_join(metadata.slug_candidates(title, F.lit("s")), "|").alias("slugs"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '10.3390/s' || (p_partkey % 3) || '-' || p_partkey END AS doi FROM part")
def issue_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first work of a search's answer that is of the volume and issue asked for."""
    n = F.col("p_partkey")
    work = lambda i, volume, issue: F.struct(F.concat(F.lit(f"10.3390/s{i}-"), n).alias("DOI"), F.lit(volume).alias("volume"), F.lit(issue).alias("issue"))
    works = F.array(work(0, "7", "1"), work(1, "7", "2"), work(2, "7", "2"))
    asked = F.when(n % 3 == 0, "1").when(n % 3 == 1, "2").otherwise("9")
    return table(spark, folder, "part").select("p_partkey", metadata.work_of_issue(works, F.lit("7"), asked)["DOI"].alias("doi"))


@query("SELECT p_partkey, p_name AS title, 'A. One; B. Two' AS authors, CAST(1990 + p_partkey % 30 AS VARCHAR) AS year, CASE p_partkey % 3 WHEN 0 THEN 'https://repo.example/' || p_partkey || '.pdf' WHEN 1 THEN 'https://arxiv.org/pdf/2101.00001.pdf' ELSE 'https://dl.acm.org/doi/pdf/10.1145/' || p_partkey END AS pdf FROM part")
def paper_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of a service's answers: metadata and the best file, open copy, preprint or publisher's."""
    n = F.col("p_partkey")
    body = F.to_json(F.struct(F.col("p_name").alias("title"), (F.lit(1990) + n % 30).cast("int").alias("year"), F.array(F.struct(F.lit("A. One").alias("name")), F.struct(F.lit("B. Two").alias("name"))).alias("authors"), F.struct(F.when(n % 3 == 0, F.concat(F.lit("https://repo.example/"), n, F.lit(".pdf"))).otherwise("https://dl.acm.org/x").alias("url")).alias("openAccessPdf"), F.struct(F.when(n % 3 == 1, "2101.00001").alias("ArXiv")).alias("externalIds")))
    paper = table(spark, folder, "part").select("p_partkey", F.from_json(body, metadata.PAPER_DDL).alias("p"))
    best = metadata.best_open_pdf(F.col("p.openAccessPdf.url"), F.col("p.externalIds.ArXiv"), F.concat(F.lit("https://dl.acm.org/doi/pdf/10.1145/"), F.col("p_partkey")), ["dl.acm.org"])
    return paper.select("p_partkey", "p.title", F.array_join(F.transform("p.authors", lambda a: a["name"]), "; ").alias("authors"), F.col("p.year").cast("string").alias("year"), best.alias("pdf"))


# --- inputs --------------------------------------------------------------------------------------


@query("WITH q AS (SELECT id, coalesce(project, '') AS p, original_input AS t, source_type AS s FROM queue_items WHERE original_input IS NOT NULL) SELECT p AS input_id, length(string_agg(t, chr(10) ORDER BY CASE WHEN s = 'direct_url' THEN 0 WHEN s = 'bibtex' THEN 2 ELSE 1 END, id)) AS n FROM q WHERE s IN ('direct_url', 'bibtex') OR trim(t) <> '' GROUP BY 1")
def input_merge(spark: SparkSession, folder: str) -> DataFrame:
    """What was typed, piped and read from files, as one text per project."""
    items = table(spark, folder, "queue_items").filter("original_input IS NOT NULL").select(F.coalesce("project", F.lit("")).alias("input_id"), F.col("id").alias("ord"), F.col("original_input").alias("text"), "source_type")
    of = lambda test: items.filter(test).drop("source_type")
    merged = merged_input(of("source_type = 'direct_url'"), of("source_type NOT IN ('direct_url', 'bibtex')"), of("source_type = 'bibtex'"))
    return joined_input(merged).select("input_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT ris_id AS input_id, coalesce(doi, url) AS text FROM ris_entries WHERE coalesce(doi, url) IS NOT NULL UNION ALL SELECT ris_id, nullif(concat_ws(' ', nullif(trim(authors), ''), '(' || year || ')', CASE WHEN trim(title) LIKE '%.' THEN trim(title) WHEN trim(title) <> '' THEN trim(title) || '.' END), '') FROM ris_entries WHERE nullif(concat_ws(' ', nullif(trim(authors), ''), '(' || year || ')', nullif(trim(title), '')), '') IS NOT NULL")
def input_ris_values(spark: SparkSession, folder: str) -> DataFrame:
    """RIS records as inputs to be parsed anew, by their values alone."""
    raw = table(spark, folder, "ris_entries").select(F.col("ris_id").alias("input_id"), F.col("raw").alias("text"))
    return values_of_items(parsing.ris_items(parsing.ris_entries(parsing.ris_records(raw))))


@query("SELECT 0 AS part, 'url' AS kind, count(*) AS n FROM part UNION ALL SELECT 0, 'doi', count(*) FROM part UNION ALL SELECT 1, k, count(*) FROM (SELECT CASE WHEN doi IS NOT NULL THEN 'doi' WHEN url IS NOT NULL THEN 'url' END AS k FROM ris_entries) WHERE k IS NOT NULL GROUP BY 2 UNION ALL SELECT 1, 'reference', count(*) FROM ris_entries")
def input_all_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of texts and of bibliography files together, counted by where they come from and kind."""
    n = F.col("p_partkey")
    texts = table(spark, folder, "part").select(n.alias("input_id"), F.concat(F.lit("https://x.example/"), n, F.lit(" 10.5555/p"), n).alias("text"))
    raw = table(spark, folder, "ris_entries").select(F.col("ris_id").alias("input_id"), F.col("raw").alias("text"))
    items = parsing.with_file_items(parsing.parsed_items(texts), parsing.ris_items(parsing.ris_entries(parsing.ris_records(raw))))
    return items.groupBy("part", "kind").agg(F.count("*").alias("n"))


@query("SELECT input_id, octet_length(encode(l)) > 20 AND (regexp_matches(l, '\\b(18|19|20)[0-9]{2}\\b') OR length(l) - length(replace(l, ',', '')) >= 3 OR regexp_matches(lower(l), 'journal|vol\\.|pp\\.|et al\\.')) AS is_reference FROM (SELECT id AS input_id, trim(original_input) AS l FROM queue_items WHERE original_input IS NOT NULL)")
def reference_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs that look like references by themselves."""
    items = table(spark, folder, "queue_items").filter("original_input IS NOT NULL")
    return items.select(F.col("id").alias("input_id"), parsing.is_reference_line(F.col("original_input")).alias("is_reference"))


@query("SELECT meta_id, CASE WHEN coalesce(trim(authors), '') = '' THEN title ELSE title || '. ' || title || '. ' || authors END AS text FROM queue_metadata")
def topics_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text keywords are taken from, where a title comes with more."""
    return table(spark, folder, "queue_metadata").select("meta_id", topic.title_and_abstract(F.col("title"), F.col("authors")).alias("text"))


@query(None)
def topics_of_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of titles with their authors behind them."""
    texts = table(spark, folder, "queue_metadata").select(F.col("meta_id").alias("doc_id"), topic.title_and_abstract(F.col("title"), F.col("authors")).alias("text"))
    return topic.rake(texts)


@query(f"SELECT id, {extension('url')} AS extension, {canonical('url')} AS canonical FROM {LOG}")
def log_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the history in their forms."""
    return views.attempts(spark, folder).select("id", urls.extension(F.col("url")).alias("extension"), urls.canonical_url(F.col("url")).alias("canonical"))
