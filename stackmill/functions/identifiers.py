"""DOIs and other identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackmill.functions.urls import canonical_host, host, path

# Identifier patterns and publisher prefixes.
DOI_URL_PREFIX = r"^https?://(?:dx\.)?doi\.org/"
DOI_VALID = r"^10\.[0-9]{4,}(?:\.[^/]*)?/.+"
ARXIV_ID = r"^(?i)(?:[0-9]{4}\.[0-9]{4,5}|[a-z\-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?$"
PMC_LINE, PMID_LINE, ARXIV_LINE = r"^(?i)PMC[0-9]{4,}$", r"^(?i)PMID[:\s]\s*[0-9]{1,9}$", r"^(?i)arXiv:\s*"
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
PII = r"(?i)/(?:science/article/(?:abs/|am/)?pii|pii)/([A-Z0-9]{8,32})"


def _found(value: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def stripped(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, EDGES, "")


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")), value)


def parsed_doi(value: Column) -> Column:
    """DOI without address or label, percent-decoded, letter case kept."""
    bare = F.regexp_replace(F.regexp_replace(stripped(value), DOI_URL_PREFIX, ""), r"^(?i)doi:\s*", "")
    return stripped(_decoded(bare))


def registry_doi(value: Column) -> Column:
    """As ``parsed_doi`` in lower case; null when nothing is left."""
    return F.nullif(F.lower(parsed_doi(F.regexp_replace(stripped(value), r"^(?i)https?://(?:dx\.)?doi\.org/", ""))), F.lit(""))


def history_doi(value: Column) -> Column:
    """DOI without address or label, neither decoded nor changed in case."""
    return F.regexp_replace(stripped(value), r"^(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def valid_doi(value: Column) -> Column:
    return value.rlike(DOI_VALID)


def known_id(line: Column) -> Column:
    """PMC, arXiv or PubMed identifier that is a whole line, in normal form; null otherwise."""
    text = F.trim(line)
    bare = F.regexp_replace(text, ARXIV_LINE, "")
    return (
        F.when(text.rlike(PMC_LINE), F.upper(text))
        .when(text.rlike(ARXIV_ID), text)
        .when(text.rlike(ARXIV_LINE) & bare.rlike(ARXIV_ID), bare)
        .when(text.rlike(PMID_LINE), F.concat(F.lit("PMID:"), F.regexp_extract(text, r"([0-9]{1,9})$", 1)))
    )


def dedup_key(doi: Column, url: Column) -> Column:
    """``doi:...`` where there is a DOI, else ``url:...``, else null."""
    from stackmill.functions.urls import canonical_url

    return F.coalesce(F.concat(F.lit("doi:"), registry_doi(doi)), F.concat(F.lit("url:"), F.nullif(canonical_url(url), F.lit(""))))


def arxiv_id(value: Column, kind: Column) -> Column:
    """arXiv identifier of a DOI, an address or a bare identifier."""
    of_doi = lambda d: F.when(F.lower(F.trim(d)).startswith("10.48550/"), F.regexp_replace(F.trim(d), r"^10\.48550/(?i:arxiv\.)?", ""))
    at = canonical_host(host(value))
    of_url = F.when(at == "arxiv.org", F.coalesce(_found(path(value), r"^/abs/(.+)$"), F.regexp_replace(_found(path(value), r"^/pdf/(.+)$"), r"\.pdf$", ""))).when(at == "doi.org", of_doi(F.ltrim(path(value), F.lit("/"))))
    found = F.when(kind == "doi", of_doi(value)).when(kind == "url", of_url).when(kind == "unknown", F.trim(value))
    tidy = F.trim(found, F.lit("/"))
    return F.when(tidy.rlike(ARXIV_ID), tidy)


def acm_doi(url: Column) -> Column:
    return F.when(host(url) == "dl.acm.org", F.rtrim(_found(path(url), r"(10\.1145/[0-9.]*[0-9][0-9.]*)"), F.lit(".")))


def wiley_doi(url: Column) -> Column:
    return F.when(host(url) == "onlinelibrary.wiley.com", F.rtrim(_found(path(url), r"(10\.(?:1002|1111)/[A-Za-z0-9._()\-]+)"), F.lit(".")))


def pii(value: Column) -> Column:
    return _found(value, PII)


def pmcid(value: Column) -> Column:
    return F.upper(_found(value, r"(?i)\b(PMC[0-9]{4,})\b"))


def pmid(url: Column) -> Column:
    """The first path segment of digits alone."""
    return F.try_element_at(F.filter(F.split(path(url), "/"), lambda p: p.rlike(r"^[0-9]+$")), F.lit(1))


def meta_doi(value: Column) -> Column:
    """A DOI as a page states it: only a label is dropped."""
    return stripped(F.regexp_replace(stripped(value), r"^(?i)doi:", ""))


def has_doi_prefix(value: Column, *prefixes: str) -> Column:
    """A DOI of one of the prefixes, whatever its letter case."""
    low = F.lower(stripped(value))
    found = low.startswith(prefixes[0].lower())
    for prefix in prefixes[1:]:
        found = found | low.startswith(prefix.lower())
    return found


def ieee_number(url: Column) -> Column:
    """Document number of a document page, else the arnumber of the query."""
    return F.coalesce(_found(url, r"/document/([0-9]+)"), _found(url, r"(?i)[?&]arnumber=([0-9]+)"))


def springer_doi(url: Column) -> Column:
    """DOI in the path of an article, chapter or file page."""
    found = F.regexp_replace(_found(path(url), r"^/(?:article|chapter|content/pdf)/(.+)$"), r"(?:\.pdf)+$", "")
    return F.when(has_doi_prefix(found, "10.1007/"), found)


def video_id(url: Column) -> Column:
    """Video of a short link, a watch page or a shorts page."""
    at = host(url)
    watch = F.when(path(url) == "/watch", _found(url, r"[?&]v=([^&#]+)"))
    return F.when(at == "youtu.be", F.nullif(F.ltrim(path(url), F.lit("/")), F.lit(""))).when(at.isin("www.youtube.com", "youtube.com"), F.coalesce(watch, _found(path(url), r"^/shorts/+(.+)$")))


def mdpi_article(url: Column) -> Column:
    """(issn, volume, issue, article) of an article path; null otherwise."""
    pattern = r"^/+([0-9]{4}-[0-9]{4})/+([0-9]+)/+([0-9]+)/+([0-9]+)(?:/pdf)?/*$"
    part = lambda i: F.regexp_extract(path(url), pattern, i)
    return F.when(path(url).rlike(pattern), F.struct(part(1).alias("issn"), part(2).alias("volume"), part(3).alias("issue"), part(4).alias("article")))
