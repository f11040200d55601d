"""Download history: current attempts, filters, search candidates and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions.urls import clean_domain_filter, host_within

# Limits and the least similarity of a fuzzy match.
DEFAULT_LIMIT, MOST_ROWS, FUZZY = 200, 10_000, 0.86


def current_attempts(log: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per attempt (``keys``): of rows delivered again, the one logged last; of equal times, one and the same of them.

    An attempt does not change once it is logged: a row delivered again repeats it with a later
    ``logged_at``. So filters on an attempt's own columns belong before this, where they reach the scan.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc("logged_at"), F.xxhash64(*log.columns))
    return log.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def newest(log: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first attempts in descending order of columns that end in ``id``, one row each, in that order.

    The page is found by a top-k over those columns alone; only its rows, of at most ``limit``
    attempts, are folded. Nothing else is shuffled whole.
    """
    page = log.select(*order).distinct().orderBy(*map(F.desc, order)).limit(limit)
    met = page.select(*[F.col(c).alias(f"_{c}") for c in order])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    held = log.join(F.broadcast(met), same, "left_semi")  # at most ``limit`` rows
    return current_attempts(held).orderBy(*map(F.desc, order)) if "logged_at" in log.columns else held.orderBy(*map(F.desc, order))


def limit_or_default(limit: int) -> int:
    """0 means the default; never above the greatest page."""
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MOST_ROWS)


def attempts(
    log: DataFrame,
    status: str | None = None,
    project: str | None = None,
    since: str | None = None,
    until: str | None = None,
    after_id: int | None = None,
    before_id: int | None = None,
    domain: str | None = None,
    uncertain_only: bool = False,
    limit: int = 0,
) -> DataFrame:
    """Attempts that pass every given filter, newest id first, cut after filtering.

    ``log`` may hold attempts delivered again. Times are compared as the text they are stored as,
    ends included. Only given filters enter the plan, so they reach the scan.
    """
    if since and until and since > until:
        raise ValueError("since is after until")
    conditions: list[Column] = []
    for column, value in (("status", status), ("project", project)):
        if value is not None:
            conditions.append(F.col(column) == value)
    if since is not None:
        conditions.append(F.col("started_at") >= since)
    if until is not None:
        conditions.append(F.col("started_at") <= until)
    if after_id is not None:
        conditions.append(F.col("id") > after_id)
    if before_id is not None:
        conditions.append(F.col("id") < before_id)
    if uncertain_only:
        conditions.append(F.col("parse_confidence") == "low")
    if domain is not None and (wanted := clean_domain_filter(domain)):
        conditions.append(host_within(F.col("url"), wanted))
    for condition in conditions:
        log = log.filter(condition)
    return newest(log, ["id"], limit_or_default(limit))


def merged_sources(log: DataFrame, source: str, limit: int) -> DataFrame:
    """The newest attempts over several sources, with ``truncated``: whether there are more.

    ``log`` may hold attempts delivered again; ids repeat between sources. One more row than asked for
    is taken, as a merge of each source's newest would; which rows these are does not depend on the
    sources, so one top-k over all of them gives them, and only they are folded.
    """
    order = [F.desc("started_at"), F.desc("id"), F.asc(source)]
    names = ["started_at", "id", source]
    page = log.select(*names).distinct().orderBy(*order).limit(limit + 1).select(*[F.col(c).alias(f"_{c}") for c in names])
    held = log.join(F.broadcast(page), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left_semi")  # at most limit + 1 attempts
    held = current_attempts(held, (source, "id"))
    total = F.count("*").over(Window.partitionBy())
    placed = held.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", total > limit)
    return placed.filter(F.col("_n") <= limit).drop("_n")


def search_sources(log: DataFrame, source: str, cap: int = MOST_ROWS) -> DataFrame:
    """The most recent searchable attempts of every source, ``cap`` of each: the set a search over several histories ranks.

    Rows that cannot be among them are cut within tasks before the shuffle.
    """
    order = [F.desc("started_at"), F.desc("id")]
    held = log.filter(F.coalesce("title", "authors", "doi").isNotNull())
    return held.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def absolute_path(file_path: Column, history_path: Column) -> Column:
    """A relative file path made absolute by the folder that holds the history's hidden folder."""
    root = F.nullif(F.regexp_extract(history_path, r"^(.*)/[^/]+/[^/]+$", 1), F.lit(""))
    return F.when(file_path.startswith("/"), file_path).otherwise(F.coalesce(F.concat(root, F.lit("/"), file_path), file_path))


def search_candidates(log: DataFrame, since: str | None = None, until: str | None = None, openable: bool = False, cap: int = MOST_ROWS) -> DataFrame:
    """Attempts with a title, authors or a DOI, the most recent first, at most ``cap``: the set a search ranks."""
    log = log.filter(F.coalesce("title", "authors", "doi").isNotNull())
    if since is not None:
        log = log.filter(F.col("started_at") >= since)
    if until is not None:
        log = log.filter(F.col("started_at") <= until)
    if openable:
        log = log.filter("status = 'success' AND file_path IS NOT NULL")
    columns = ["id", "url", "status", "file_path", "title", "authors", "doi", "started_at"]
    return newest(log.select(*columns, *[c for c in ("logged_at",) if c in log.columns]), ["started_at", "id"], cap).select(*columns)


def search_text(value: Column) -> Column:
    """Lower-case text with white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def _alike(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def match_of(query: Column, value: Column) -> Column:
    """(kind, similarity) of a value: 3 equal, 2 contained, 1 alike; null when none of them."""
    text = search_text(value)
    tokens = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)
    fuzzy = F.greatest(_alike(query, text), F.coalesce(F.array_max(F.transform(tokens, lambda t: _alike(query, t))), F.lit(0.0)))
    found = lambda kind, similarity: F.struct(F.lit(kind).alias("kind"), similarity.alias("similarity"))
    return F.when(text == "", None).when(text == query, found(3, F.lit(1.0))).when(F.contains(text, query), found(2, F.length(query) / F.length(text))).when(fuzzy >= FUZZY, found(1, fuzzy))


def ranked(candidates: DataFrame, query: str, limit: int) -> DataFrame:
    """Candidates by their best field: kind, similarity, then recency. On ties title beats authors beats DOI."""
    text = " ".join(query.split()).lower()
    fields = ["title", "authors", "doi"]
    options = F.array(*[F.struct(match_of(F.lit(text), F.col(f)).alias("m"), F.lit(-i).alias("rank"), F.lit(f).alias("field")) for i, f in enumerate(fields)])
    best = F.array_max(F.filter(options, lambda o: o["m"].isNotNull()))
    out = candidates.withColumn("_b", best).filter("_b IS NOT NULL")
    out = out.select("id", "title", "authors", "doi", "started_at", "file_path", F.col("_b.m.kind").alias("match_kind"), F.col("_b.m.similarity").alias("similarity"), F.col("_b.field").alias("matched_field"))
    return out.orderBy(F.desc("match_kind"), F.desc("similarity"), F.desc("started_at"), F.desc("id")).limit(limit)
