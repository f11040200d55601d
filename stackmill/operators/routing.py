"""Routing of parsed items to resolution rules, and chasing their redirects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions import identifiers as ids
from stackmill.functions.urls import canonical_host, host, path
from stackmill.session import cut

Predicate = Callable[[Column, Column], Column]

# Where preprints and publishers' files lie.
ARXIV_PDF, ACM_PDF, WILEY_PDF = "https://arxiv.org/pdf/", "https://dl.acm.org/doi/pdf/", "https://onlinelibrary.wiley.com/doi/pdf/"


@dataclass(frozen=True)
class Rule:
    """A named rule: lower priority numbers come first, then the order of registration."""

    name: str
    priority: int
    accepts: Predicate
    transform: Predicate | None = None


def _doi(value: Column, kind: Column, prefixes: list[str]) -> Column:
    """A DOI of one of the prefixes, as such or at doi.org."""
    of = lambda v: F.lower(F.trim(v)).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    return ((kind == "doi") & of(value)) | ((kind == "url") & (canonical_host(host(value)) == "doi.org") & of(F.ltrim(path(value), F.lit("/"))))


def _at(value: Column, kind: Column, wanted: str) -> Column:
    return (kind == "url") & (canonical_host(host(value)) == wanted)


# Hosts, DOI prefixes and path patterns of the sources.
RULES = [
    Rule("arxiv", 1, lambda v, k: ids.arxiv_id(v, k).isNotNull(), lambda v, k: F.concat(F.lit(ARXIV_PDF), ids.arxiv_id(v, k), F.lit(".pdf"))),
    Rule("pubmed", 1, lambda v, k: ((k == "unknown") & F.trim(v).rlike(r"^(?i)(?:PMC[0-9]{4,}|PMID:[0-9]{1,9})$")) | (_at(v, k, "pmc.ncbi.nlm.nih.gov") & F.lower(path(v)).contains("/articles/pmc")) | _at(v, k, "pubmed.ncbi.nlm.nih.gov")),
    Rule("ieee", 1, lambda v, k: _doi(v, k, ["10.1109/"]) | (_at(v, k, "ieeexplore.ieee.org") & (path(v).rlike(r"/document/|/stamp/stamp\.jsp") | F.lower(v).rlike(r"\?.*arnumber=")))),
    Rule("oxford", 1, lambda v, k: _doi(v, k, ["10.1093/"]) | (_at(v, k, "academic.oup.com") & F.lower(path(v)).rlike(r"/(?:advance-)?article(?:-abstract|-pdf)?/"))),
    Rule("springer", 1, lambda v, k: _doi(v, k, ["10.1007/"]) | (_at(v, k, "link.springer.com") & path(v).rlike(r"^/(?:article|chapter|content/pdf)/"))),
    Rule("sciencedirect", 1, lambda v, k: _doi(v, k, ["10.1016/"]) | (_at(v, k, "sciencedirect.com") & ~F.lower(path(v)).rlike(r"\.pdf$|/pdfft|/pdf$|/downloadpdf") & (path(v).startswith("/science/article/") | ids.pii(path(v)).isNotNull()))),
    Rule("acm", 1, lambda v, k: ((k == "doi") & F.lower(F.trim(v)).startswith("10.1145/")) | ((k == "url") & ids.acm_doi(v).isNotNull()), lambda v, k: F.concat(F.lit(ACM_PDF), F.when(k == "doi", F.trim(v)).otherwise(ids.acm_doi(v)))),
    Rule("wiley", 1, lambda v, k: ((k == "doi") & F.lower(F.trim(v)).rlike(r"^10\.(?:1002|1111)/")) | ((k == "url") & ids.wiley_doi(v).isNotNull()), lambda v, k: F.concat(F.lit(WILEY_PDF), F.when(k == "doi", F.trim(v)).otherwise(ids.wiley_doi(v)))),
    Rule("mdpi", 1, lambda v, k: ((k == "doi") & F.lower(F.trim(v)).startswith("10.3390/")) | (_at(v, k, "mdpi.com") & ids.mdpi_article(v).isNotNull())),
    Rule("youtube", 1, lambda v, k: (k == "url") & ids.video_id(v).isNotNull()),
    Rule("crossref", 2, lambda v, k: k == "doi"),
    Rule("direct", 3, lambda v, k: k == "url", lambda v, k: v),
]


def route(value: Column, kind: Column, rules: list[Rule] | None = None) -> Column:
    """Name of the first rule that accepts the item; null when none does (references and BibTeX, by design)."""
    ordered = sorted(rules or RULES, key=lambda r: r.priority)
    return F.coalesce(*[F.when(F.coalesce(r.accepts(value, kind), F.lit(False)), F.lit(r.name)) for r in ordered])


def handlers(value: Column, kind: Column, rules: list[Rule] | None = None) -> Column:
    """Names of all rules that accept the item, in the order they are tried."""
    ordered = sorted(rules or RULES, key=lambda r: r.priority)
    return F.filter(F.array(*[F.when(F.coalesce(r.accepts(value, kind), F.lit(False)), F.lit(r.name)) for r in ordered]), lambda n: n.isNotNull())


def registered(rules: list[Rule], rule: Rule) -> list[Rule]:
    """The rules with one more; of equal priority the earlier registered come first."""
    return [*rules, rule]


def resolved(value: Column, kind: Column, rules: list[Rule] | None = None) -> Column:
    """(rule, step, url) of the first rule that accepts the item and makes something of it.

    A rule's ``transform`` gives the address it leads to, or null when it fails and the next is
    tried; ``step`` is ``url``, ``no_resolver`` where no rule accepts the item, or ``all_failed``.
    """
    ordered = sorted(rules or RULES, key=lambda r: r.priority)
    made = [F.when(F.coalesce(r.accepts(value, kind), F.lit(False)) & r.transform(value, kind).isNotNull(), F.struct(F.lit(r.name).alias("rule"), F.lit("url").alias("step"), r.transform(value, kind).alias("url"))) for r in ordered if r.transform is not None]
    none = F.lit(None).cast("string")
    lost = F.struct(none.alias("rule"), F.when(F.size(handlers(value, kind, rules)) == 0, "no_resolver").otherwise("all_failed").alias("step"), none.alias("url"))
    return F.coalesce(*made, lost)


def chased(items: DataFrame, redirects: DataFrame, most_hops: int = 10) -> DataFrame:
    """Adds ``final_url``, ``hops`` and ``kind``: every item followed through ``redirects`` (url, target).

    An item that was redirected is an address from then on, whatever it was. Each round joins only
    the rows that moved in the last one, and the loop ends when none did; chains longer than the
    bound end with ``final_url`` null.
    """
    redirects = redirects.select(F.col("url").alias("_at"), F.col("target").alias("_to")).groupBy("_at").agg(F.min("_to").alias("_to"))
    kind = F.col("kind") if "kind" in items.columns else F.lit("url")
    live = items.withColumn("final_url", F.col("url")).withColumn("hops", F.lit(0)).withColumn("kind", kind)
    columns = live.columns
    done: list[DataFrame] = []
    for hop in range(most_hops + 1):
        met = cut(live.join(redirects, live["final_url"] == redirects["_at"], "left").drop("_at"))
        done.append(met.filter("_to IS NULL").select(*columns))
        live = met.filter("_to IS NOT NULL").withColumn("final_url", F.col("_to")).withColumn("hops", F.lit(hop + 1)).withColumn("kind", F.lit("url")).select(*columns)
        if not live.head(1):
            break
    lost = live.withColumn("final_url", F.lit(None).cast("string"))
    for part in done:
        lost = lost.unionByName(part)
    return lost
