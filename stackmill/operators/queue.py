"""The work queue as an event log: enqueuing, claims, transitions, listings, state folding, duplicates in flight, registry.

A change of state is a row appended to the log of events, never an update in place; ``folded`` gives
the state. Every transition is a DataFrame of ids in, a DataFrame of events out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions import identifiers
from stackmill.functions.urls import canonical_url
from stackmill.plans.ordered import numbered_table

# Defaults of a new item, what of a work's metadata it keeps, and the reasons of skipped attempts.
PRIORITY, RETRIES = 0, 0
METADATA = ["suggested_filename", "meta_title", "meta_authors", "meta_year", "meta_doi", "topics", "parse_confidence", "parse_confidence_factors"]
SKIP_REASONS = {"active": "duplicate_active", "hit": "duplicate_existing", "stale": "stale_mapping_recovered"}


def _scoped(queue: DataFrame, project: str | None) -> DataFrame:
    return queue if project is None else queue.filter(F.col("project") == project)


def _queue_order() -> list[Column]:
    """Greatest priority, oldest, least id: equal creation times are common, so the id decides."""
    return [F.desc("priority"), F.asc("created_at"), F.asc("id")]


def enqueued(queue: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """New pending rows of ``queue``'s columns for (ord, url, source_type, original_input, project, metadata).

    Ids go on from the greatest of the queue in the order of ``ord``; whatever of the metadata is
    not given is null. One number, the greatest id, comes to the driver.
    """
    last = queue.agg(F.max("id")).first()[0] or 0
    rows = numbered_table(items, "ord", "_n")
    made = {"id": F.lit(last + 1) + F.col("_n"), "status": F.lit("pending"), "priority": F.lit(PRIORITY).cast("bigint"), "retry_count": F.lit(RETRIES).cast("bigint"), "created_at": F.lit(now), "updated_at": F.lit(now)}
    given = {c for c in ("url", "source_type", "original_input", "project", *METADATA) if c in items.columns}
    types = dict(queue.dtypes)
    return rows.select(*[(made[c] if c in made else F.col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in queue.columns])


def claim_batch(queue: DataFrame, size: int, project: str | None = None) -> DataFrame:
    """The next pending items: greatest priority, oldest, least id."""
    return _scoped(queue.filter("status = 'pending'"), project).orderBy(*_queue_order()).limit(size)


def listed(queue: DataFrame, status: str | None = None, project: str | None = None) -> DataFrame:
    """Items of a status, or all, in queue order."""
    return _scoped(queue if status is None else queue.filter(F.col("status") == status), project).orderBy(*_queue_order())


def in_progress(queue: DataFrame, project: str | None = None) -> DataFrame:
    """Items in progress, the longest untouched first."""
    return _scoped(queue.filter("status = 'in_progress'"), project).orderBy(F.asc("updated_at"), F.asc("id"))


def by_id(queue: DataFrame, item: int) -> DataFrame:
    """The item of an id; the filter reaches the scan."""
    return queue.filter(F.col("id") == item)


def counts(queue: DataFrame) -> DataFrame:
    """Items per project and status."""
    return queue.groupBy("project", "status").agg(F.count("*").alias("items"))


def recovered(queue: DataFrame, project: str | None = None) -> DataFrame:
    """The queue after a crash: what was in progress is pending again."""
    stuck = F.col("status") == "in_progress"
    if project is not None:
        stuck = stuck & (F.col("project") == project)
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def cleared(queue: DataFrame, status: str) -> DataFrame:
    """The queue without the items of a status; items of unknown status stay."""
    return queue.filter(~F.col("status").eqNullSafe(status))


# --- transitions ---------------------------------------------------------------------------------

EVENT = "id bigint, seq bigint, status string, retry_count bigint, saved_path string, last_error string, bytes_downloaded bigint, content_length bigint, updated_at string"


def _event(changes: DataFrame, **values: Column) -> DataFrame:
    """Events of (id, seq, updated_at, ...): what a change does not touch is null, and folding keeps what was."""
    fields = [f.split() for f in EVENT.split(", ")]
    kept = {c: F.col(c) for c in ("id", "seq", "updated_at")} | values
    return changes.select(*[kept.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def first_events(queue: DataFrame) -> DataFrame:
    """A queue as the first event (seq 0) of each of its items."""
    return _event(queue.withColumn("seq", F.lit(0)), **{c: F.col(c) for c in ("status", "retry_count", "saved_path", "last_error", "bytes_downloaded", "content_length")})


def claimed(items: DataFrame) -> DataFrame:
    return _event(items, status=F.lit("in_progress"))


def completed(items: DataFrame) -> DataFrame:
    """Completions of (id, seq, updated_at, saved_path); a null path is stored as an empty one, so that it replaces an older."""
    return _event(items, status=F.lit("completed"), saved_path=F.coalesce("saved_path", F.lit("")))


def failed(items: DataFrame) -> DataFrame:
    """Failures of (id, seq, updated_at, last_error, retry_count)."""
    return _event(items, status=F.lit("failed"), last_error=F.col("last_error"), retry_count=F.col("retry_count"))


def progressed(items: DataFrame) -> DataFrame:
    """Progress of (id, seq, updated_at, bytes_downloaded, content_length); an unknown length is stored as -1."""
    return _event(items, bytes_downloaded=F.col("bytes_downloaded"), content_length=F.coalesce("content_length", F.lit(-1)))


def requeued(items: DataFrame) -> DataFrame:
    return _event(items, status=F.lit("pending"))


def removed(items: DataFrame) -> DataFrame:
    return _event(items, status=F.lit("removed"))


def unknown_ids(events: DataFrame) -> DataFrame:
    """Events of ids that no item was ever enqueued under: the errors of transitions."""
    known = events.filter("seq = 0").select("id")
    return events.filter("seq > 0").join(known, "id", "left_anti")


def replayed(events: DataFrame) -> DataFrame:
    """State of every item of an event log: per value the last event that sets it, without removed and unknown items.

    One aggregation of maxima of (seq, value), combined before the shuffle.
    """
    values = [f.split()[0] for f in EVENT.split(", ") if f.split()[0] not in ("id", "seq")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(c)
    state = events.groupBy("id").agg(F.min("seq").alias("_first"), *[last(c) for c in values])
    state = state.filter("_first = 0").select("id", *[F.col(f"{c}.v").alias(c) for c in values]).filter("status != 'removed'")
    return state.withColumn("saved_path", F.nullif("saved_path", F.lit(""))).withColumn("content_length", F.when(F.col("content_length") >= 0, F.col("content_length")))


def folded(events: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Current state of an event log: per key the values of its last event; tombstones are gone.

    ``events`` has (key, seq, status, ...). One aggregation with partial maxima; a key of many
    events is combined before the shuffle.
    """
    values = [c for c in events.columns if c not in (key, seq)]
    last = events.groupBy(key).agg(F.max(F.struct(F.col(seq), *values)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in values]).filter("status != 'removed'")


# --- runs ------------------------------------------------------------------------------------------


def run_stats(attempts: DataFrame) -> DataFrame:
    """(completed, failed, total, retried) of a run's attempts, as one row: retries are those of its last attempts."""
    done, lost = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return attempts.agg(done.alias("completed"), lost.alias("failed"), (done + lost).alias("total"), F.coalesce(F.sum(F.when(F.col("status").isin("success", "failed"), F.col("retry_count"))), F.lit(0)).alias("retried"))


def exit_outcome(completed: Column, failed: Column) -> Column:
    """success without failures, partial beside some completions, else failure."""
    return F.when(failed == 0, "success").when(completed > 0, "partial").otherwise("failure")


def run_is_over(completed: Column, failed: Column, before_completed: Column, before_failed: Column, enqueued: Column) -> Column:
    """What was enqueued has come to an end, earlier runs' items aside."""
    return F.greatest(completed - before_completed, F.lit(0)) + F.greatest(failed - before_failed, F.lit(0)) >= enqueued


def resolution_outcome(items: DataFrame) -> DataFrame:
    """Counters of (ord, outcome, error) as one row, with the first error.

    Outcomes: enqueued, duplicate, auth_failed, other_failed, enqueue_failed.
    """
    count = lambda k: F.count_if(F.col("outcome") == k)
    lost = F.col("outcome").isin("auth_failed", "other_failed")
    first = lambda test: F.min(F.when(test & F.col("error").isNotNull(), F.struct("ord", "error")))["error"]
    return items.agg(
        F.count("*").alias("parsed"), count("enqueued").alias("enqueued"), count("duplicate").alias("duplicates"), count("auth_failed").alias("auth_failed"), count("other_failed").alias("other_failed"), count("enqueue_failed").alias("enqueue_failed"),
        F.coalesce(F.bool_or(lost | (F.col("outcome") == "enqueue_failed")), F.lit(False)).alias("has_failures"), first(lost).alias("first_resolution_error"), first(F.col("outcome") == "enqueue_failed").alias("first_enqueue_error"),
    )


def logged(attempts: DataFrame, now: str) -> DataFrame:
    """Attempts as rows of the history: both times are now, a last retry only where a failure came after retries."""
    retried = (F.col("status") == "failed") & (F.col("retry_count") > 0)
    return attempts.withColumn("started_at", F.lit(now)).withColumn("completed_at", F.lit(now)).withColumn("last_retry_at", F.when(retried, F.lit(now)))


def skipped_attempts(items: DataFrame, queue: DataFrame, registry: DataFrame, now: str) -> DataFrame:
    """History rows of the items that are not downloaded again, or that a stale registry entry would have hidden.

    ``items`` has (url, project, original_input, meta_title, meta_authors, meta_doi); an item already
    queued or in progress counts as active before the registry is asked.
    """
    active = in_flight(items, queue).withColumn("found", F.lit("active"))
    none = F.lit(None).cast("string")
    rest = not_in_flight(items, queue).withColumn("doi_key", identifiers.dedup_key(F.col("meta_doi"), none)).withColumn("url_key", identifiers.dedup_key(none, F.col("url")))
    asked = looked_up(rest, registry).withColumnRenamed("outcome", "found").drop("doi_key", "url_key")
    reason = F.coalesce(*[F.when(F.col("found") == k, F.lit(v)) for k, v in SKIP_REASONS.items()])
    rows = active.unionByName(asked.select(*active.columns)).withColumn("error_message", reason).filter("error_message IS NOT NULL")
    rows = rows.select("url", F.col("url").alias("final_url"), F.lit("skipped").alias("status"), "error_message", F.lit(0).cast("bigint").alias("retry_count"), "project", "original_input", F.lit(0).cast("bigint").alias("duration_ms"), F.col("meta_title").alias("title"), F.col("meta_authors").alias("authors"), F.col("meta_doi").alias("doi"))
    return logged(rows, now)


def newly_failed(queue: DataFrame, before: DataFrame) -> DataFrame:
    """(input, error) of the items that failed since ``before``: an anti join on ids."""
    lost = queue.filter("status = 'failed'").join(before.select("id"), "id", "left_anti")
    return lost.select("id", F.coalesce("original_input", "url").alias("input"), F.coalesce("last_error", F.lit("Unknown error")).alias("error"))


def _active(queue: DataFrame) -> DataFrame:
    return queue.filter("status IN ('pending', 'in_progress')").select("url", F.coalesce("project", F.lit("")).alias("_p")).distinct()


def in_flight(items: DataFrame, queue: DataFrame) -> DataFrame:
    """Items whose address and project are already pending or in progress."""
    return items.withColumn("_p", F.coalesce("project", F.lit(""))).join(_active(queue), ["url", "_p"], "left_semi").drop("_p")


def not_in_flight(items: DataFrame, queue: DataFrame) -> DataFrame:
    """The other items."""
    return items.withColumn("_p", F.coalesce("project", F.lit(""))).join(_active(queue), ["url", "_p"], "left_anti").drop("_p")


def newly_completed(queue: DataFrame, before: DataFrame) -> DataFrame:
    """Completed items whose id was not completed before the run."""
    return queue.filter("status = 'completed'").join(before.select("id"), "id", "left_anti")


# --- registry --------------------------------------------------------------------------------------


def recorded(done: DataFrame) -> DataFrame:
    """(dedup_key, canonical_doi, canonical_url, relative_path, seen_at): two entries of each success, by address and by DOI.

    ``done`` has (url, doi, relative_path, seen_at); without a DOI there is one.
    """
    doi, url = identifiers.registry_doi(F.col("doi")), canonical_url(F.col("url"))
    keyed = done.select("relative_path", "seen_at", doi.alias("canonical_doi"), url.alias("canonical_url"))
    keys = F.filter(F.array(F.concat(F.lit("url:"), F.col("canonical_url")), F.concat(F.lit("doi:"), F.col("canonical_doi"))), lambda k: k.isNotNull())
    return keyed.select(F.explode(keys).alias("dedup_key"), "canonical_doi", "canonical_url", "relative_path", "seen_at")


def upserted(registry: DataFrame, finished: DataFrame) -> DataFrame:
    """Registry with finished items: first sight kept, last sight and what comes with it taken over.

    Both have (dedup_key, relative_path, seen_at) and the same other columns; of equal times the
    greater path wins.
    """
    both = registry.unionByName(finished).filter("dedup_key IS NOT NULL")
    values = ["relative_path", *[c for c in both.columns if c not in ("dedup_key", "relative_path", "seen_at")]]
    out = both.groupBy("dedup_key").agg(F.min("seen_at").alias("first_seen_at"), F.max(F.struct("seen_at", *values)).alias("_last"))
    return out.select("dedup_key", *[F.col(f"_last.{c}").alias(c) for c in values], "first_seen_at", F.col("_last.seen_at").alias("last_seen_at"))


def without_stale(registry: DataFrame, stale: DataFrame) -> DataFrame:
    """Registry without the entries whose file is gone (dedup_key)."""
    return registry.join(stale.select("dedup_key"), "dedup_key", "left_anti")


def looked_up(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items with ``outcome``: hit, stale (known, but the file is gone) or miss.

    ``items`` has doi_key and url_key, tried in this order; ``registry`` has (dedup_key, present).
    A known file that is present under either key is a hit. Items without a key ask for one that no
    entry has, each another, so they meet in no task of their own.
    """
    nothing = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("doi_key", "url_key"), F.lit(4096)).cast("string"))
    met = items
    for key in ("doi_key", "url_key"):
        answers = registry.select(F.col("dedup_key").alias("_ask"), F.col("present").alias(f"_{key}"))
        met = met.withColumn("_ask", F.coalesce(F.col(key), nothing)).join(answers, "_ask", "left").drop("_ask")
    either = F.coalesce("_doi_key", "_url_key")
    hit = F.coalesce("_doi_key", F.lit(False)) | F.coalesce("_url_key", F.lit(False))
    return met.withColumn("outcome", F.when(hit, "hit").when(either.isNotNull(), "stale").otherwise("miss")).drop("_doi_key", "_url_key")
