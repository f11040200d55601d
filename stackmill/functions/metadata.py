"""Metadata of captured service responses: links, papers, article numbers, cookies and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackmill.functions.urls import host

# Hosts that only redirect, and the address pattern of a journal's file store.
REDIRECT_HOSTS = ["doi.org", "dx.doi.org"]
FILE_STORE = "https://mdpi-res.com/d_attachment/%1$s/%2$s/article_deploy/%2$s.pdf"
JOURNAL_SLUGS = {"applied sciences": "applsci"}
DATE = "struct<`date-parts`:array<array<int>>>"
WORK_DDL = f"struct<message:struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,published:{DATE},`published-print`:{DATE},`published-online`:{DATE},`container-title`:array<string>,volume:string,issue:string>>"
PAPER_DDL = "struct<title:string,year:int,authors:array<struct<name:string>>,openAccessPdf:struct<url:string>,externalIds:struct<ArXiv:string,DOI:string>>"
LINK_DDL = "array<struct<URL:string,`content-type`:string,`intended-application`:string>>"


def best_link(links: Column) -> Column:
    """Address of the first link of type PDF, else for similarity checking, else for text mining."""
    first = lambda test: F.try_element_at(F.filter(links, test), F.lit(1))["URL"]
    use = lambda link: F.lower(link["intended-application"])
    return F.coalesce(first(lambda link: F.lower(F.trim(F.split_part(link["content-type"], F.lit(";"), F.lit(1)))) == "application/pdf"), first(lambda link: use(link) == "similarity-checking"), first(lambda link: use(link) == "text-mining"))


def usable_open_url(url: Column, rejected: list[str]) -> Column:
    """An https address that neither only redirects nor lies at or below a rejected domain."""
    at = host(url)
    below = [(at == d) | F.endswith(at, F.lit(f".{d}")) for d in rejected]
    bad = at.isin(REDIRECT_HOSTS)
    for test in below:
        bad = bad | test
    return F.coalesce(url.startswith("https://") & ~bad, F.lit(False))


def best_open_pdf(open_url: Column, arxiv: Column, publisher: Column, rejected: list[str]) -> Column:
    """The open copy if usable, else the preprint, else the publisher's address."""
    return F.coalesce(F.when(usable_open_url(open_url, rejected), open_url), F.concat(F.lit("https://arxiv.org/pdf/"), F.nullif(arxiv, F.lit("")), F.lit(".pdf")), publisher)


def journal_slug(doi: Column) -> Column:
    """Leading letters of an article DOI's suffix."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(doi)), r"^10\.3390/([a-z]+)", 1), F.lit(""))


def article_number(doi: Column, slug: Column, volume: Column, issue: Column) -> Column:
    """Digits after slug, volume and issue, the issue as it is or padded to two digits."""
    tail = F.when(F.startswith(F.lower(F.trim(doi)), F.concat(F.lit("10.3390/"), slug, volume)), F.substring(F.lower(F.trim(doi)), F.length(F.concat(F.lit("10.3390/"), slug, volume)) + 1, F.length(doi)))
    after = lambda part: F.when(F.startswith(tail, part), F.substring(tail, F.length(part) + 1, F.length(tail)))
    rest = F.coalesce(after(issue), after(F.lpad(issue, 2, "0")))
    return F.when(rest.rlike(r"^[0-9]+$"), rest)


def slug_candidates(title: Column, doi_slug: Column) -> Column:
    """Names under which the file store may hold a journal, in the order to try them, each once.

    A title of one word is the name; of more, its letters alone, the DOI's slug and a known exception.
    """
    low = F.lower(title)
    known = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in JOURNAL_SLUGS.items()])
    several = F.array_distinct(F.filter(F.array(F.regexp_replace(low, r"[^a-z]", ""), doi_slug, known), lambda s: s.isNotNull()))
    return F.when(title.isNull(), F.array(doi_slug)).when(~F.contains(low, F.lit(" ")), F.array(low)).otherwise(several)


def work_names(authors: Column) -> Column:
    """``Family, Given`` of a work's authors, whichever part there is, joined by semicolons; null without any."""
    names = F.filter(F.transform(authors, lambda a: F.concat_ws(", ", a["family"], a["given"])), lambda n: n != "")
    return F.nullif(F.array_join(names, "; "), F.lit(""))


def work_year(message: Column) -> Column:
    """Year of a work: as published, else in print, else online."""
    first = lambda name: F.try_element_at(F.try_element_at(message[name]["date-parts"], F.lit(1)), F.lit(1))
    return F.coalesce(first("published"), first("published-print"), first("published-online")).cast("string")


def work_of_issue(works: Column, volume: Column, issue: Column) -> Column:
    """The first of a search's works of this volume and issue; null without one."""
    return F.try_element_at(F.filter(works, lambda w: (w["volume"] == volume) & (w["issue"] == issue)), F.lit(1))


def store_url(slug: Column, volume: Column, number: Column) -> Column:
    """Address of an article in the file store; its number padded to five digits."""
    return F.format_string(FILE_STORE, slug, F.concat_ws("-", slug, volume, F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)))


def set_cookie(name: Column, value: Column, domain: Column, path: Column, secure: Column, expires: Column) -> Column:
    """A Set-Cookie text; session cookies (expiry 0) have no Expires."""
    date = F.concat(F.date_format(F.timestamp_seconds(expires), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return F.concat_ws("; ", F.concat(name, F.lit("="), value), F.concat(F.lit("Domain="), domain), F.concat(F.lit("Path="), path), F.when(secure, "Secure"), F.when(expires > 0, F.concat(F.lit("Expires="), date)))


def cookie_origin(domain: Column, path: Column, secure: Column) -> Column:
    return F.concat(F.when(secure, "https://").otherwise("http://"), F.regexp_replace(domain, r"^\.", ""), path)


def parse_summary(counts: dict[str, Column], levels: dict[str, Column]) -> Column:
    """One line on what was parsed: items by kind, and the confidence of references where there are any."""
    total = sum(counts.values(), F.lit(0))
    head = F.format_string("Parsed %d items: %d URLs, %d DOIs, %d references, %d BibTeX", total, counts["url"], counts["doi"], counts["reference"], counts["bibtex"])
    trust = F.when(counts["reference"] > 0, F.format_string(" [reference confidence: high=%d, medium=%d, low=%d]", levels["high"], levels["medium"], levels["low"])).otherwise("")
    return F.concat(head, trust, F.when(levels["low"] > 0, F.format_string(" (%d references need verification)", levels["low"])).otherwise(""))
