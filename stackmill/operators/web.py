"""Metadata of pages, robots rules and cookies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions.identifiers import pii, stripped
from stackmill.functions.urls import absolute, origin, path

# Named character references, in the order they are replaced.
ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&nbsp;", "\u00a0"), ("&#8211;", "\u2013"), ("&#8212;", "\u2014"), ("&#160;", "\u00a0")]
#: Of each publisher: path parts of login pages, phrases that alone tell a wall, phrases of which ``least`` tell one.
WALLS = {
    "ieee": (["/login", "/servlet/login"], [], ["sign in", "institutional sign in", "access through your institution", "purchase pdf", "subscribe to ieee xplore"], 2),
    "oxford": (["/login", "/sign-in"], ["you do not currently have access to this article", "this pdf is available to subscribers only"], ["sign in", "access through your institution", "subscribe", "purchase", "institutional login", "available to subscribers only"], 2),
    "springer": ([], [], ["buy article", "purchase pdf", "access through your institution", "log in via an institution", "subscribe to this journal"], 2),
    "sciencedirect": (["/user/login"], ["id.elsevier.com"], ["sign in", "institutional access", "access through your institution", "single sign-on", "shibboleth"], 3),
}
#: Of each publisher: the meta names of its PDF, and the pattern of a link to one, tried after them.
PDF_FORMS = {
    "oxford": (["citation_pdf_url"], r"(?is)href\s*=\s*[\"']([^\"']*/(?:advance-)?article-pdf/[^\"']+)[\"']"),
    "sciencedirect": (["citation_pdf_url", "pdf_url"], r"\"(?:pdfUrl|pdfDownloadUrl|linkToPdf)\"\s*:\s*\"([^\"]+)\""),
    "pubmed": (["citation_pdf_url"], r"(?is)href\s*=\s*[\"']([^\"']*(?:/pdf/[^\"']*|\.pdf[^\"']*))[\"']"),
    "springer": (["citation_pdf_url"], r"(?is)href\s*=\s*[\"']([^\"']*/content/pdf/[^\"']+\.pdf[^\"']*)[\"']"),
    "ieee": (["citation_pdf_url"], r"(?i)(/stamp/stamp\.jsp\?[^\"']*arnumber=[0-9]+[^\"']*)"),
}
#: Names under which publishers state a work's data, first one first.
WORK_NAMES = {"title": ["citation_title", "dc.title"], "doi": ["citation_doi", "dc.identifier"], "journal": ["citation_journal_title"], "date": ["citation_publication_date"]}
COOKIE_JSON = "struct<domain:string,host:string,hostOnly:boolean,path:string,secure:boolean,name:string,value:string,expirationDate:double,expires:double>"
META_TAG = r"(?is)(<meta\s+[^>]*>)"


def unescaped(text: Column) -> Column:
    """Character references replaced one after the other, ampersands first."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return stripped(text)


def _attribute(tag: Column, names: str) -> Column:
    double, single = F.regexp_extract(tag, rf'(?is)\b(?:{names})\s*=\s*"([^"]*)"', 1), F.regexp_extract(tag, rf"(?is)\b(?:{names})\s*=\s*'([^']*)'", 1)
    return F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")))


def meta_tags(html: Column) -> Column:
    """Array of (name, content) of the meta tags that have both, names in lower case."""
    tags = F.regexp_extract_all(html, F.lit(META_TAG), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(stripped(_attribute(t, "name|property"))).alias("name"), unescaped(stripped(_attribute(t, "content"))).alias("content")))
    return F.filter(pairs, lambda p: p["name"].isNotNull() & p["content"].isNotNull())


def first_meta(tags: Column, *names: str) -> Column:
    """Content of the first tag that has one of the names."""
    return F.try_element_at(F.filter(tags, lambda p: p["name"].isin(*names)), F.lit(1))["content"]


def all_meta(tags: Column, *names: str) -> Column:
    """Distinct contents of the tags with one of the names, in order."""
    return F.array_distinct(F.transform(F.filter(tags, lambda p: p["name"].isin(*names) & (p["content"] != "")), lambda p: p["content"]))


def meta_value(html: Column, name: str) -> Column:
    """Content of the first meta tag of a name whose content comes after it, as it stands there; null without one."""
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<meta\s+[^>]*(?:name|property)\s*=\s*[\"']{re.escape(name)}[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"']", 1)), F.lit(""))


def work_metadata(html: Column) -> Column:
    """(title, authors, doi, journal, year) that a publisher's page states in its meta tags; authors joined by semicolons."""
    tags = meta_tags(html)
    doi = first_meta(tags, *WORK_NAMES["doi"])
    authors = F.nullif(F.array_join(all_meta(tags, "citation_author"), "; "), F.lit(""))
    year = F.nullif(F.regexp_extract(first_meta(tags, *WORK_NAMES["date"]), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))
    return F.struct(first_meta(tags, *WORK_NAMES["title"]).alias("title"), authors.alias("authors"), F.trim(F.regexp_replace(doi, r"^(?i)doi:", "")).alias("doi"), first_meta(tags, *WORK_NAMES["journal"]).alias("journal"), year.alias("year"))


def publisher_pdf(html: Column, final_url: Column, publisher: str) -> Column:
    """Absolute address of the PDF a publisher's page offers: by meta tag, by link, by template; null without one."""
    names, link = PDF_FORMS[publisher]
    found = F.nullif(F.regexp_extract(html, link, 1), F.lit(""))
    if publisher == "sciencedirect":
        found = F.replace(F.replace(found, F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
        found = F.coalesce(found, F.concat(F.lit("https://www.sciencedirect.com/science/article/pii/"), pii(final_url), F.lit("/pdfft?isDTMRedir=true&download=true")))
    elif publisher == "oxford":
        found = unescaped(found)
    tagged = first_meta(meta_tags(html), *names) if publisher in ("oxford", "sciencedirect") else meta_value(html, names[0])
    return absolute(F.coalesce(tagged, found), final_url)


def wall(html: Column, final_url: Column, publisher: str) -> Column:
    """The page asks for a login or a purchase: by its address, by one telling phrase or by several others."""
    paths, telling, phrases, least = WALLS[publisher]
    at, any_of = F.lower(path(final_url)), lambda text, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p)) if parts else F.lit(False)
    return F.coalesce(any_of(at, paths), F.lit(False)) | F.coalesce(any_of(F.lower(html), telling) | shows_wall(html, phrases, least), F.lit(False))


def title(html: Column) -> Column:
    return F.nullif(F.trim(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def pdf_link(html: Column) -> Column:
    """The citation_pdf_url tag, else the first link to a PDF."""
    return F.coalesce(first_meta(meta_tags(html), "citation_pdf_url"), F.nullif(F.regexp_extract(html, r"(?is)href\s*=\s*[\"']([^\"']*(?:/pdf/|\.pdf)[^\"']*)[\"']", 1), F.lit("")))


def shows_wall(html: Column, markers: list[str], least: int) -> Column:
    """At least ``least`` of the marker phrases occur."""
    text = F.lower(html)
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0)) >= least


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, prefix) of the groups for every agent, of (origin, body) files.

    The last User-agent line before a rule decides, case matters, Allow is not read.
    """
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    agent = F.when(F.col("line").startswith("User-agent:"), F.trim(F.regexp_replace("line", "^User-agent:", "")))
    before = Window.partitionBy("origin").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(before))
    rules = held.filter("agent IN ('*', '') AND startswith(line, 'Disallow:')").withColumn("prefix", F.trim(F.regexp_replace("line", "^Disallow:", "")))
    rooted = F.regexp_replace(F.regexp_replace("prefix", r"^(?!/)", "/"), r"\*+$", "")
    return rules.filter("prefix != ''").select("origin", rooted.alias("prefix")).filter("prefix != ''").distinct()


def longest_first(rules: DataFrame) -> DataFrame:
    """(origin, prefixes): the rules of each origin, the longest first, then by text."""
    order = F.array_sort(F.collect_set(F.struct((-F.length("prefix")).alias("n"), "prefix")))
    return rules.groupBy("origin").agg(F.transform(order, lambda x: x["prefix"]).alias("prefixes"))


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests whose path begins with no forbidden prefix of their origin: an anti join on the origin."""
    asked = requests.withColumn("_o", origin(F.col("url"))).withColumn("_path", path(F.col("url")))
    met = (asked["_o"] == rules["origin"]) & F.startswith(asked["_path"], rules["prefix"])
    return asked.join(rules, met, "left_anti").drop("_o", "_path")


def netscape_cookies(lines: DataFrame) -> DataFrame:
    """Cookie lines as fields with ``problem``, beside the other columns; comments and blank lines are no rows.

    A line has 7 fields: domain, tailmatch, path, secure, expires, name, value.
    """
    rows = lines.withColumn("line", F.regexp_replace("line", r"\s+$", "")).filter("line != '' AND NOT startswith(line, '#')")
    f = F.split("line", "\t")
    item = lambda i: F.try_element_at(f, F.lit(i))
    flag = lambda i: F.upper(item(i)).isin("TRUE", "FALSE")
    expires = F.when(item(5).rlike(r"^\+?[0-9]+$"), item(5).try_cast("bigint"))
    problem = F.when(F.size(f) != 7, "not seven fields").when(~flag(2) | ~flag(4), "flag is neither TRUE nor FALSE").when(expires.isNull(), "expiry is no number").when(item(1) == "", "no domain").when(item(6) == "", "no name")
    return rows.select(*lines.columns, item(1).alias("domain"), (F.upper(item(2)) == "TRUE").alias("tailmatch"), item(3).alias("path"), (F.upper(item(4)) == "TRUE").alias("secure"), expires.alias("expires"), item(6).alias("name"), item(7).alias("value"), problem.alias("problem"))


def looks_like_json(text: Column) -> Column:
    """An array or object by its first character."""
    return F.substring(stripped(text), 1, 1).isin("[", "{")


def json_cookies(texts: DataFrame) -> DataFrame:
    """Cookies of captured JSON with ``problem``, an array or an object with ``cookies``; texts that are neither give no rows.

    A domain may be an address; ``hostOnly``, else a leading dot, says whether it holds below the domain.
    """
    plain = F.from_json("text", f"array<{COOKIE_JSON}>")
    wrapped = F.from_json("text", f"struct<cookies:array<{COOKIE_JSON}>>")["cookies"]
    listed = F.when(F.substring(F.trim("text"), 1, 1) == "[", plain).otherwise(wrapped)
    rows = texts.select(*[c for c in texts.columns if c != "text"], F.inline(F.coalesce(listed, F.array().cast(f"array<{COOKIE_JSON}>"))))
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("domain", "host", F.lit(""))), r"^https?://", ""), r"/.*$", "")
    tail = F.coalesce(~F.col("hostOnly"), F.startswith(bare, F.lit(".")))
    host = F.ltrim(bare, F.lit("."))
    at = F.coalesce(F.col("path"), F.lit("/"))
    expires = F.coalesce("expirationDate", "expires", F.lit(0.0))
    problem = F.when(bare == "", "no domain").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.coalesce("value", F.lit("")) == "", "no value")
    kept = [c for c in texts.columns if c != "text"]
    return rows.select(*kept, F.when(tail, F.concat(F.lit("."), host)).otherwise(host).alias("domain"), tail.alias("tailmatch"), F.when(F.trim(at) == "", "/").when(at.startswith("/"), at).otherwise(F.concat(F.lit("/"), at)).alias("path"), F.coalesce("secure", F.lit(False)).alias("secure"), F.when(expires > 0, F.floor(expires).cast("bigint")).otherwise(0).alias("expires"), F.trim("name").alias("name"), "value", problem.alias("problem"))


def captured_cookies(texts: DataFrame, now: int) -> DataFrame:
    """Cookies of captured texts (capture, text), JSON or cookie lines by their first character, with ``problem`` of those set apart.

    Besides the problems of either form, cookies without a value and expired ones are set apart; an
    empty path is the root.
    """
    json = json_cookies(texts.filter(looks_like_json(F.col("text"))).select("capture", "text"))
    lines = texts.filter(~looks_like_json(F.col("text"))).select("capture", F.explode(F.split("text", r"\n")).alias("line"))
    plain = netscape_cookies(lines).drop("line")
    both = json.withColumn("format", F.lit("json")).unionByName(plain.withColumn("format", F.lit("netscape")))
    problem = F.coalesce("problem", F.when(F.trim("domain") == "", "no domain").when(F.trim("name") == "", "no name").when(F.col("value") == "", "no value").when((F.col("expires") > 0) & (F.col("expires") <= now), "expired"))
    return both.withColumn("path", F.when(F.trim("path") == "", "/").otherwise(F.col("path"))).withColumn("problem", problem)


def domain_count(cookies: DataFrame) -> DataFrame:
    """How many domains there are, leading dots aside."""
    return cookies.agg(F.countDistinct(F.ltrim(F.col("domain"), F.lit("."))).alias("domains"))


def cookie_status(cookies: DataFrame, now: int) -> DataFrame:
    """Per domain without its leading dot: valid, session or expired, the best that one of its cookies is."""
    at = F.regexp_replace("domain", r"^\.", "")
    rank = F.when(F.col("expires") == 0, 2).when(F.col("expires") > now, 3).otherwise(1)
    best = cookies.groupBy(at.alias("domain")).agg(F.max(rank).alias("_r"), F.count("*").alias("cookies"))
    return best.select("domain", "cookies", F.element_at(F.array(F.lit("expired"), F.lit("session"), F.lit("valid")), F.col("_r")).alias("validity"))
