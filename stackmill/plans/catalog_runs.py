"""Queries on the queue's life, runs, the registry and reports, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import failures, identifiers
from stackmill.operators import exports, history, queue, rates
from stackmill.plans import views
from stackmill.plans.catalog_sql import CORPUS_BIBTEX, LOG, MESSAGE_CLASS, QUEUE, RANKED, TOPICS, TYPE_CLASS, TYPE_WHAT, canonical, dedup_key, file_name, host, registry_doi, schedule, status_class, stripped, truncated
from stackmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW, SESSION = "2023-12-31 23:59:59", "2023-12-31_23h59m59s"
BEFORE = "2022-06-01 00:00:00"
START_ID = 100


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _cases(column: str, table_: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table_.items()) + " END"


# --- listings ------------------------------------------------------------------------------------


@query(f"SELECT id, status, priority, created_at FROM {QUEUE}")
def queue_list_all(spark: SparkSession, folder: str) -> DataFrame:
    """The whole queue in its order."""
    return queue.listed(views.queue_items(spark, folder)).select("id", "status", "priority", "created_at")


@query(f"SELECT id, project, updated_at FROM {QUEUE} WHERE status = 'in_progress'")
def queue_in_progress(spark: SparkSession, folder: str) -> DataFrame:
    return queue.in_progress(views.queue_items(spark, folder)).select("id", "project", "updated_at")


@query("SELECT id, url, status, original_input FROM queue_items WHERE id = 17")
def queue_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return queue.by_id(table(spark, folder, "queue_items"), 17).select("id", "url", "status", "original_input")


@query(f"SELECT project, status, count(*) AS items FROM {QUEUE} WHERE status <> 'failed' GROUP BY 1, 2")
def queue_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """Counts after the failed items are cleared."""
    return queue.counts(queue.cleared(views.queue_items(spark, folder), "failed"))


# --- transitions ---------------------------------------------------------------------------------

_KNOWN = f"(SELECT url FROM {QUEUE} GROUP BY url)"


@query(f"SELECT max_id + row_number() OVER (ORDER BY first_seen) AS id, url, 'pending' AS status, CAST(0 AS BIGINT) AS priority, project, '{NOW}' AS created_at FROM (SELECT url, min(id) AS first_seen, (arg_min(coalesce(project, ''), id)) AS project FROM {LOG} WHERE url NOT IN (SELECT url FROM {_KNOWN} WHERE url IS NOT NULL) GROUP BY url), (SELECT max(id) AS max_id FROM queue_items)")
def queue_enqueue(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses of the history that the queue does not hold, enqueued in the order of their first attempt."""
    items = views.queue_items(spark, folder)
    log = views.attempts(spark, folder).select("id", "url", F.coalesce("project", F.lit("")).alias("project"))
    first = log.groupBy("url").agg(F.min(F.struct("id", "project")).alias("f")).join(items.select("url").distinct(), "url", "left_anti")
    new = first.select(F.col("f.id").alias("ord"), "url", F.lit("direct_url").alias("source_type"), F.col("url").alias("original_input"), F.col("f.project").alias("project"))
    return queue.enqueued(items, new, NOW).select("id", "url", "status", "priority", "project", "created_at")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The queue's events: its state as it was, then what the history says of each item's address in its project."""
    items = views.queue_items(spark, folder)
    first = queue.first_events(items)
    met = items.select("id", "url", F.coalesce("project", F.lit("")).alias("_p")).join(views.attempts(spark, folder).select(F.col("id").alias("seq"), "url", F.coalesce("project", F.lit("")).alias("_p"), F.col("status").alias("_s"), F.col("started_at").alias("updated_at"), F.col("file_path").alias("saved_path"), F.col("error_message").alias("last_error"), "retry_count", F.col("file_size").alias("bytes_downloaded"), F.lit(None).cast("bigint").alias("content_length")), ["url", "_p"])
    of = lambda s: met.filter(F.col("_s") == s)
    done, lost = of("success"), of("failed")
    progress = done.withColumn("seq", F.col("seq") * 10 + 1)
    parts = [queue.progressed(progress), queue.completed(done.withColumn("seq", F.col("seq") * 10 + 2)), queue.failed(lost.withColumn("seq", F.col("seq") * 10 + 2)), queue.requeued(of("skipped").withColumn("seq", F.col("seq") * 10 + 2)), queue.claimed(met.withColumn("seq", F.col("seq") * 10))]
    for part in parts:
        first = first.unionByName(part)
    return first


_MET = f"(SELECT q.id, l.id AS seq, l.status AS s, l.started_at, l.file_path, l.error_message, l.retry_count, l.file_size FROM {QUEUE} q JOIN {LOG} l ON q.url = l.url AND coalesce(q.project, '') = coalesce(l.project, ''))"
_LAST = f"(SELECT id, arg_max(CASE s WHEN 'success' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'pending' END, seq) AS status, max(started_at) FILTER (WHERE false) AS nothing, arg_max(started_at, seq) AS updated_at, arg_max(file_path, seq) FILTER (WHERE s = 'success') AS saved_path, arg_max(error_message, seq) FILTER (WHERE s = 'failed' AND error_message IS NOT NULL) AS last_error, arg_max(retry_count, seq) FILTER (WHERE s = 'failed' AND retry_count IS NOT NULL) AS retry_count, arg_max(file_size, seq) FILTER (WHERE s = 'success' AND file_size IS NOT NULL) AS bytes_downloaded, bool_or(s = 'success') AS done FROM {_MET} GROUP BY id)"


@query(f"SELECT q.id, coalesce(e.status, q.status) AS status, coalesce(e.retry_count, q.retry_count) AS retry_count, coalesce(e.saved_path, q.saved_path) AS saved_path, coalesce(e.last_error, q.last_error) AS last_error, coalesce(e.bytes_downloaded, q.bytes_downloaded) AS bytes_downloaded, CASE WHEN e.done THEN NULL ELSE q.content_length END AS content_length, coalesce(e.updated_at, q.updated_at) AS updated_at FROM {QUEUE} q LEFT JOIN {_LAST} e ON e.id = q.id")
def queue_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after claims, progress, completions, failures and requeues of the whole history are replayed."""
    return queue.replayed(_events(spark, folder))


@query(f"SELECT project, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END)::BIGINT AS completed, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, CASE WHEN sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) = 0 THEN 'success' WHEN sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'failure' END AS outcome FROM {LOG} GROUP BY 1")
def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How every project's attempts ended."""
    log = views.attempts(spark, folder)
    per = log.groupBy("project").agg(F.count_if(F.col("status") == "success").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return per.withColumn("outcome", queue.exit_outcome(F.col("completed"), F.col("failed")))


@query(f"SELECT count(*) FILTER (WHERE status = 'success') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('success', 'failed')) AS total, CAST(coalesce(sum(retry_count) FILTER (WHERE status IN ('success', 'failed')), 0) AS BIGINT) AS retried FROM {LOG}")
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return queue.run_stats(views.attempts(spark, folder))


@query(f"SELECT project, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'completed' AND updated_at < '{BEFORE}') AS completed_before, greatest(count(*) FILTER (WHERE status = 'completed') - count(*) FILTER (WHERE status = 'completed' AND updated_at < '{BEFORE}'), 0) + greatest(count(*) FILTER (WHERE status = 'failed') - count(*) FILTER (WHERE status = 'failed' AND updated_at < '{BEFORE}'), 0) >= count(*) FILTER (WHERE created_at >= '{BEFORE}') AS over FROM {QUEUE} GROUP BY 1")
def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Per project what earlier runs had completed, and whether what came since has ended."""
    old = F.col("updated_at") < BEFORE
    count = lambda status, *more: F.count_if((F.col("status") == status) & (more[0] if more else F.lit(True)))
    per = views.queue_items(spark, folder).groupBy("project").agg(count("completed").alias("completed"), count("completed", old).alias("completed_before"), count("failed").alias("failed"), count("failed", old).alias("failed_before"), F.count_if(F.col("created_at") >= BEFORE).alias("enqueued"))
    over = queue.run_is_over(F.col("completed"), F.col("failed"), F.col("completed_before"), F.col("failed_before"), F.col("enqueued"))
    return per.select("project", "completed", "completed_before", over.alias("over"))


_OUTCOMES = f"(SELECT id AS ord, CASE WHEN status = 'success' THEN 'enqueued' WHEN status = 'skipped' THEN 'duplicate' WHEN error_type = 'auth' THEN 'auth_failed' WHEN error_type IS NOT NULL THEN 'other_failed' ELSE 'enqueue_failed' END AS outcome, error_message AS error FROM {LOG})"


@query(f"SELECT count(*) AS parsed, count(*) FILTER (WHERE outcome = 'enqueued') AS enqueued, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'auth_failed') AS auth_failed, count(*) FILTER (WHERE outcome = 'other_failed') AS other_failed, count(*) FILTER (WHERE outcome = 'enqueue_failed') AS enqueue_failed, coalesce(bool_or(outcome LIKE '%failed'), false) AS has_failures, arg_min(error, ord) FILTER (WHERE outcome IN ('auth_failed', 'other_failed') AND error IS NOT NULL) AS first_resolution_error, arg_min(error, ord) FILTER (WHERE outcome = 'enqueue_failed' AND error IS NOT NULL) AS first_enqueue_error FROM {_OUTCOMES}")
def resolution_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of what the history says became of each input."""
    kind = F.when(F.col("status") == "success", "enqueued").when(F.col("status") == "skipped", "duplicate").when(F.col("error_type") == "auth", "auth_failed").when(F.col("error_type").isNotNull(), "other_failed").otherwise("enqueue_failed")
    return queue.resolution_outcome(views.attempts(spark, folder).select(F.col("id").alias("ord"), kind.alias("outcome"), F.col("error_message").alias("error")))


_KEYS = f"(SELECT {dedup_key('doi', 'url')} AS key, bool_or(file_path LIKE '%.pdf') AS present FROM {LOG} WHERE status = 'success' GROUP BY 1)"


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    done = views.attempts(spark, folder, "status = 'success'")
    known = done.select(identifiers.dedup_key(F.col("doi"), F.col("url")).alias("dedup_key"), F.col("file_path").endswith(".pdf").alias("present"))
    return known.filter("dedup_key IS NOT NULL").groupBy("dedup_key").agg(F.bool_or("present").alias("present"))


@query(f"WITH q AS (SELECT *, 'doi:' || {registry_doi('meta_doi')} AS dk, 'url:' || nullif({canonical('url')}, '') AS uk FROM {QUEUE}), a AS (SELECT DISTINCT url, coalesce(project, '') AS p FROM {QUEUE} WHERE status IN ('pending', 'in_progress')), r AS (SELECT q.*, a.url IS NOT NULL AS active, b.present AS x, c.present AS y FROM q LEFT JOIN a ON a.url = q.url AND a.p = coalesce(q.project, '') LEFT JOIN {_KEYS} b ON b.key = q.dk LEFT JOIN {_KEYS} c ON c.key = q.uk), n AS (SELECT url, CASE WHEN active THEN 'duplicate_active' WHEN coalesce(x, false) OR coalesce(y, false) THEN 'duplicate_existing' WHEN coalesce(x, y) IS NOT NULL THEN 'stale_mapping_recovered' END AS error_message FROM r) SELECT url, error_message, 'skipped' AS status, '{NOW}' AS started_at, CAST(NULL AS VARCHAR) AS last_retry_at, count(*) AS n FROM n WHERE error_message IS NOT NULL GROUP BY 1, 2")
def skipped_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The history rows that queueing everything once more would leave, counted per address and reason."""
    items = views.queue_items(spark, folder)
    rows = queue.skipped_attempts(items, items, _registry(spark, folder), NOW)
    return rows.groupBy("url", "error_message", "status", "started_at", "last_retry_at").agg(F.count("*").alias("n"))


@query(f"SELECT id, '{NOW}' AS started_at, '{NOW}' AS completed_at, CASE WHEN status = 'failed' AND retry_count > 0 THEN '{NOW}' END AS last_retry_at FROM {LOG}")
def log_insert(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts as they are logged: both times now, a last retry only for failures after retries."""
    return queue.logged(views.attempts(spark, folder), NOW).select("id", "started_at", "completed_at", "last_retry_at")


@query(f"SELECT id, coalesce(original_input, url) AS input, coalesce(last_error, 'Unknown error') AS error FROM {QUEUE} WHERE status = 'failed' AND NOT updated_at < '{BEFORE}'")
def newly_failed_anti(spark: SparkSession, folder: str) -> DataFrame:
    """The items that failed since an earlier run."""
    items = views.queue_items(spark, folder)
    return queue.newly_failed(items, items.filter(f"status = 'failed' AND updated_at < '{BEFORE}'"))


# --- registry ------------------------------------------------------------------------------------

_RECORDED = f"(SELECT unnest(list_filter(['url:' || u, 'doi:' || d], lambda k: k IS NOT NULL)) AS dedup_key, d AS canonical_doi, u AS canonical_url, file_path, started_at FROM (SELECT {registry_doi('doi')} AS d, {canonical('url')} AS u, file_path, started_at FROM {LOG} WHERE status = 'success' AND file_path IS NOT NULL))"
_FOLDED = f"SELECT dedup_key, m.p AS relative_path, m.d AS canonical_doi, m.u AS canonical_url, first_seen_at, m.s AS last_seen_at FROM (SELECT dedup_key, max(struct_pack(s := started_at, p := file_path, d := coalesce(canonical_doi, ''), u := canonical_url)) AS m, min(started_at) AS first_seen_at FROM {_RECORDED} GROUP BY 1)"


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    done = views.attempts(spark, folder, "status = 'success' AND file_path IS NOT NULL").select("url", "doi", F.col("file_path").alias("relative_path"), F.col("started_at").alias("seen_at"))
    keyed = queue.recorded(done).withColumn("canonical_doi", F.coalesce("canonical_doi", F.lit("")))
    return queue.upserted(keyed.filter(f"seen_at < '{BEFORE}'"), keyed.filter(f"NOT seen_at < '{BEFORE}'"))


@query(_FOLDED)
def registry_record(spark: SparkSession, folder: str) -> DataFrame:
    """A registry with two entries of every success, by address and by DOI."""
    return _recorded(spark, folder)


@query(f"SELECT dedup_key, relative_path FROM ({_FOLDED}) WHERE relative_path LIKE '%.pdf'")
def registry_mark_stale(spark: SparkSession, folder: str) -> DataFrame:
    """The registry without entries whose file is no PDF any more."""
    held = _recorded(spark, folder)
    return queue.without_stale(held, held.filter("relative_path NOT LIKE '%.pdf'")).select("dedup_key", "relative_path")


# --- schedules -----------------------------------------------------------------------------------


@query(f"WITH f AS (SELECT id, {status_class('coalesce(http_status, 503)')} AS c, http_status AS h, duration_ms // 1000 AS told FROM {LOG} WHERE status = 'failed') SELECT id, CAST(a AS INT) AS attempt, CASE WHEN a = 1 OR h = 403 THEN 0 WHEN c = 'rate_limited' AND told IS NOT NULL THEN told * 1000 ELSE CAST(least(1000 * pow(2, a - 2), 32000) AS BIGINT) END AS delay_ms, a > 1 AND coalesce(h = 403, false) AS as_browser FROM f, range(1, 4) r(a) WHERE a = 1 OR c IN ('transient', 'rate_limited') OR (a = 2 AND h = 403)")
def retry_schedule_told(spark: SparkSession, folder: str) -> DataFrame:
    """Retries where servers tell how long to wait, and refusals tried once more as a browser."""
    failed = views.attempts(spark, folder, "status = 'failed'")
    given = failed.select("id", failures.status_class(F.coalesce("http_status", F.lit(503))).alias("failure"), "http_status", F.floor(F.col("duration_ms") / 1000).cast("bigint").alias("retry_after_s"))
    return rates.retry_schedule(given).select("id", "attempt", "delay_ms", "as_browser")


@query(f"WITH w AS (SELECT domain, CAST(sum(start_ms - arrived_ms) AS BIGINT) AS waited_ms FROM {schedule(60_000)} GROUP BY 1), t AS (SELECT 'host' || (user_id % 50) || '.example' AS domain, CAST(count(*) * 1000 AS BIGINT) AS told_ms FROM events WHERE event_type = 'error' GROUP BY 1) SELECT coalesce(w.domain, t.domain) AS domain, coalesce(waited_ms, 0) AS waited_ms, coalesce(told_ms, 0) AS told_ms, coalesce(waited_ms, 0) + coalesce(told_ms, 0) AS total_ms, coalesce(waited_ms, 0) + coalesce(told_ms, 0) >= 30000 AS warned FROM w FULL JOIN t ON w.domain = t.domain")
def rate_limit_told(spark: SparkSession, folder: str) -> DataFrame:
    """Waits of every domain, those its server told included."""
    requests = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("host"), F.col("user_id") % 50, F.lit(".example")).alias("domain"), F.unix_millis("ts").alias("arrived_ms"), "event_type")
    waited = rates.cumulative_wait(rates.request_schedule(requests.select("id", "domain", "arrived_ms"), 60_000))
    return rates.server_delays(waited, requests.filter("event_type = 'error'").select("domain", F.lit(1000).alias("delay_ms")))


@query(f"SELECT status, quantile_disc(duration_ms, 0.95) AS p95_ms, count(duration_ms) AS n FROM {LOG} GROUP BY 1")
def log_p95(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile of durations by the nearest rank, exactly."""
    return views.attempts(spark, folder).groupBy("status").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("bigint").alias("p95_ms"), F.count("duration_ms").alias("n"))


@query(f"SELECT count(*) FILTER (WHERE parse_confidence = 'low') AS uncertain FROM {LOG} WHERE id > {START_ID}")
def log_uncertain_count(spark: SparkSession, folder: str) -> DataFrame:
    """References of a run that need a look."""
    return views.attempts(spark, folder, f"id > {START_ID}").agg(F.count_if(F.col("parse_confidence") == "low").alias("uncertain"))


# --- reports -------------------------------------------------------------------------------------

_FILE = f"coalesce({file_name('file_path')}, title, 'n/a')"
_LINE = f"started_at || ' | ' || upper(status) || ' | ' || {_FILE} || coalesce(' | confidence=' || parse_confidence, '') || ' | ' || coalesce(original_input, url)"
_CATEGORY = f"coalesce({TYPE_CLASS}, CASE WHEN m IS NOT NULL THEN {MESSAGE_CLASS} END, 'other')"
_WHAT_OF_MESSAGE = "CASE WHEN regexp_matches(m, '^\\[AUTH\\](.|\\n)*\\(HTTP 407\\)') THEN 'Proxy authentication required' WHEN regexp_matches(m, '^\\[AUTH\\]') THEN 'Authentication required' WHEN m LIKE '%HTTP 404%' THEN 'Source not found' WHEN m LIKE '%timeout%' THEN 'Download timed out' WHEN m LIKE '%network error%' THEN 'Network request failed' WHEN m LIKE '%invalid URL%' OR m LIKE '%invalid DOI%' OR m LIKE '%could not parse reference%' THEN 'Input could not be parsed' ELSE 'Unhandled failure' END"
_WHAT = f"coalesce({TYPE_WHAT}, CASE WHEN m IS NOT NULL THEN {_WHAT_OF_MESSAGE} END, 'Unhandled failure')"
_FIX = f"coalesce({_cases(TYPE_WHAT, {k: v[1] for k, v in failures.REMEDIES.items()})}, nullif(trim(CASE WHEN m LIKE '%Suggestion:%' THEN regexp_replace(m, '^(.|\\n)*?Suggestion:', '') END), ''), '{failures.REMEDIES['Network request failed'][1]}')"


@query(f"SELECT id, {truncated(_LINE, 80)} AS row FROM {LOG}")
def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt on a line of the width of a terminal."""
    return exports.history_lines(views.attempts(spark, folder))


@query(f"SELECT id, {truncated(_LINE, 80)} || chr(10) || {truncated('w', 80)} || chr(10) || {truncated('y', 80)} || chr(10) || {truncated('f', 80)} AS row FROM (SELECT *, '  ' || {_cases('category', {k: v[0].split()[0] for k, v in failures.CLASSES.items()})} || ' What: ' || what AS w, '  Why: ' || {_cases('what', {k: v[0] for k, v in failures.REMEDIES.items()})} AS y, '  Fix: ' || fix AS f FROM (SELECT *, {_CATEGORY} AS category, {_WHAT} AS what, {_FIX} AS fix FROM (SELECT *, error_message AS m FROM {LOG}) WHERE status = 'failed'))")
def log_failed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Failed attempts with what happened, why and what to do."""
    return exports.history_lines(views.attempts(spark, folder, "status = 'failed'"), failed_only=True)


_EACH = f"(SELECT {MESSAGE_CLASS} AS category FROM (SELECT coalesce(error_message, 'unknown') AS m FROM {LOG} WHERE status = 'failed'))"


@query(f"WITH g AS (SELECT category, count(*) AS n FROM {_EACH} GROUP BY 1), r AS (SELECT *, {_cases('category', {k: str(i) for i, k in enumerate(failures.CLASSES)})}::INT AS rank FROM g), l AS (SELECT 0 AS place, 'Failure summary by category:' AS row WHERE EXISTS (SELECT 1 FROM g) UNION ALL SELECT rank * 4 + 1, '- ' || {_cases('category', {k: v[0] for k, v in failures.CLASSES.items()})} || ': ' || n FROM r UNION ALL SELECT rank * 4 + 2, '  What: ' || {_cases('category', {k: v[1] for k, v in failures.CLASSES.items()})} FROM r UNION ALL SELECT rank * 4 + 3, '  Why: ' || {_cases('category', {k: v[2] for k, v in failures.CLASSES.items()})} FROM r UNION ALL SELECT rank * 4 + 4, '  Fix: ' || {_cases('category', {k: v[3] for k, v in failures.CLASSES.items()})} FROM r) SELECT CAST(place AS INT) AS place, {truncated('row', 80)} AS row FROM l")
def failure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of all failures by class, line by line."""
    return exports.failure_summary(views.attempts(spark, folder, "status = 'failed'").select(F.col("error_message").alias("message")))


@query(f"SELECT id, {_FIX} AS suggestion FROM (SELECT *, error_message AS m FROM {LOG}) WHERE status = 'failed'")
def failure_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    failed = views.attempts(spark, folder, "status = 'failed'")
    return failed.select("id", failures.suggestion(F.col("error_type"), F.col("http_status"), F.col("error_message")).alias("suggestion"))


_KIND = "CASE error_type WHEN 'auth' THEN 'auth' WHEN 'not_found' THEN 'http_status' WHEN 'parse_error' THEN 'invalid_url' ELSE CASE WHEN error_message LIKE 'timed out%' THEN 'timeout' WHEN http_status IS NOT NULL THEN 'http_status' ELSE 'network' END END"


@query(f"SELECT id, CASE kind WHEN 'auth' THEN 'needs_auth' WHEN 'http_status' THEN {status_class('http_status')} WHEN 'timeout' THEN 'transient' WHEN 'network' THEN CASE WHEN coalesce(regexp_matches(lower(error_message), 'certificate|tls|ssl|handshake'), false) THEN 'permanent' ELSE 'transient' END ELSE 'permanent' END AS class, t AS stored_type, CASE WHEN error_message LIKE '%Suggestion:%' THEN error_message ELSE error_message || chr(10) || '  Suggestion: ' || {_cases('t', failures.SUGGESTIONS)} END AS message FROM (SELECT *, CASE kind WHEN 'auth' THEN 'auth' WHEN 'http_status' THEN CASE WHEN http_status IN (401, 403, 407) THEN 'auth' WHEN http_status = 404 THEN 'not_found' ELSE 'network' END WHEN 'invalid_url' THEN 'parse_error' ELSE 'network' END AS t FROM (SELECT *, {_KIND} AS kind FROM {LOG} WHERE status = 'failed'))")
def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Errors by kind: their class, the type they are stored with and the message that tells what to do."""
    failed = views.attempts(spark, folder, "status = 'failed'")
    message, status = F.col("error_message"), F.col("http_status")
    other = F.when(message.startswith("timed out"), "timeout").when(status.isNotNull(), "http_status").otherwise("network")
    kind = F.when(F.col("error_type") == "auth", "auth").when(F.col("error_type") == "not_found", "http_status").when(F.col("error_type") == "parse_error", "invalid_url").otherwise(other)
    rows = failed.withColumn("kind", kind).withColumn("t", failures.error_type(F.col("kind"), status))
    return rows.select("id", failures.error_class(F.col("kind"), status, message).alias("class"), F.col("t").alias("stored_type"), failures.actionable(message, F.col("t")).alias("message"))


@query(f"SELECT id, {truncated('started_at || ' + chr(39) + ' | ' + chr(39) + f' || coalesce(title, {file_name(chr(102) + chr(105) + chr(108) + chr(101) + chr(95) + chr(112) + chr(97) + chr(116) + chr(104))}, ' + chr(39) + 'n/a' + chr(39) + ') || ' + chr(39) + ' | match=' + chr(39) + ' || matched_field || ' + chr(39) + ' | ' + chr(39) + ' || coalesce(file_path, ' + chr(39) + 'n/a' + chr(39) + ')', 80)} AS row FROM ({RANKED})")
def search_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Search results on lines."""
    found = history.ranked(history.search_candidates(views.deliveries(spark, folder)), "Granular", 200)
    return exports.search_lines(found)


@query(f"WITH c AS (SELECT *, coalesce(project, '') AS source, row_number() OVER (PARTITION BY coalesce(project, '') ORDER BY started_at DESC, id DESC) AS n FROM {LOG} WHERE coalesce(title, authors, doi) IS NOT NULL) SELECT source, id, CASE WHEN file_path LIKE '/%' THEN file_path ELSE '/home/' || source || '/' || file_path END AS file_path FROM c WHERE n <= 100")
def search_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The most recent searchable attempts of every history, with absolute paths."""
    log = views.attempts(spark, folder).withColumn("source", F.coalesce("project", F.lit("")))
    held = history.search_sources(log, "source", 100)
    return held.select("source", "id", history.absolute_path(F.col("file_path"), F.concat(F.lit("/home/"), F.col("source"), F.lit("/.state/queue.db"))).alias("file_path"))


_ROW = f"CASE WHEN status = 'failed' THEN ' | reason=' || {truncated(chr(114) + 'egexp_extract(coalesce(error_message, ' + chr(39) + 'unknown failure' + chr(39) + '), ' + chr(39) + '^([^\\r\\n]*)' + chr(39) + ', 1)', 96)} ELSE '' END"
LOG_ROW = f"'- ' || started_at || ' | ' || upper(status) || ' | file=' || {truncated(_FILE, 48)} || ' | source=' || {truncated('coalesce(original_input, url)', 72)} || {_ROW} || ' | ref=history#' || id"
ORACLE_SQL["download_log_rows"] = f"SELECT id, {LOG_ROW} AS row FROM {LOG}"


@query(f"WITH f AS (SELECT * FROM {LOG} WHERE id > {START_ID} AND project IS NOT NULL), c AS (SELECT project, count(*) AS n FROM f GROUP BY 1) SELECT project, CAST(0 AS INT) AS part, CAST(NULL AS BIGINT) AS id, '## Session {SESSION} (' || n || ' attempts)' AS line FROM c UNION ALL SELECT project, 1, NULL, '' FROM c UNION ALL SELECT project, 2, id, {LOG_ROW} FROM f")
def log_section(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's new section of the log."""
    session = exports.session_label(F.lit(NOW).cast("timestamp"), F.lit(0))
    return exports.log_section(views.attempts(spark, folder), START_ID, session)


def _cell(value: str) -> str:
    return f"regexp_replace(replace(replace({value}, '|', '\\|'), '`', '\\`'), '[\\n\\r]', ' ', 'g')"


INDEX_ROW = f"'| `' || {_cell('coalesce(' + file_name('saved_path') + ', ' + chr(39) + 'unknown' + chr(39) + ')')} || '` | ' || {_cell('coalesce(meta_title, ' + chr(39) + 'n/a' + chr(39) + ')')} || ' | ' || {_cell('coalesce(meta_authors, ' + chr(39) + 'n/a' + chr(39) + ')')} || ' | <' || {_cell('url')} || '> |'"
ORACLE_SQL["index_rows"] = f"SELECT id, {INDEX_ROW} AS row FROM {QUEUE} WHERE status = 'completed'"


@query(f"WITH f AS (SELECT * FROM {QUEUE} WHERE status = 'completed' AND NOT coalesce(updated_at < '{BEFORE}', false) AND project IS NOT NULL), t AS (SELECT project, list_sort(list_distinct(flatten(list({TOPICS})))) AS topics FROM f GROUP BY 1), h AS (SELECT project, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS part FROM (SELECT project, list_concat(list_concat(['## Session {SESSION}', ''], CASE WHEN len(topics) > 0 THEN ['**Topics detected:** ' || len(topics) || ' | ' || array_to_string(topics, ', '), ''] ELSE [] END), ['{exports.INDEX_HEAD[0]}', '{exports.INDEX_HEAD[1]}']) AS l FROM t)) SELECT project, CAST(part AS INT) AS part, CAST(NULL AS BIGINT) AS id, line FROM h UNION ALL SELECT project, 6, id, {INDEX_ROW} FROM f")
def index_section(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's new section of the index."""
    items = views.queue_items(spark, folder)
    before = items.filter(f"status = 'completed' AND updated_at < '{BEFORE}'")
    return exports.index_section(items, before, exports.session_label(F.lit(NOW).cast("timestamp"), F.lit(0)))


@query(f"WITH e AS ({CORPUS_BIBTEX}), l AS (SELECT path, CASE WHEN path > (SELECT min(path) FROM e) THEN list_concat([''], string_split(entry, chr(10))) ELSE string_split(entry, chr(10)) END AS l FROM e) SELECT path, CAST(generate_subscripts(l, 1) - 1 AS INT) AS no, unnest(l) AS line FROM l")
def export_bibtex_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The bibliography as one document, line by line."""
    return exports.document_lines(exports.bibtex_entries(views.corpus(spark, folder)))


_SOME = lambda c: f"nullif({stripped(c)}, '')"


@query(f"SELECT id, regexp_replace(saved_path, '([^/])\\.[^./]*$', '\\1') || '.json' AS path, CASE WHEN length(url) % 3 = 0 THEN 'write' WHEN length(url) % 3 = 1 THEN 'keep' ELSE 'quarantine' END AS action FROM {QUEUE} WHERE status = 'completed' AND saved_path IS NOT NULL AND NOT coalesce(updated_at < '{BEFORE}', false)")
def sidecar_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a run's sidecars need: of its items some have one, some a broken one, some none."""
    items = views.queue_items(spark, folder)
    done = items.filter("status = 'completed' AND saved_path IS NOT NULL")
    held = done.filter("length(url) % 3 > 0").select(exports.sidecar_path(F.col("saved_path")).alias("path"), F.when(F.length("url") % 3 == 1, '{"a": 1}').otherwise('{"a": ').alias("document"))
    one = held.groupBy("path").agg(F.max("document").alias("document"))
    return exports.sidecar_plan(items, one, items.filter(f"status = 'completed' AND updated_at < '{BEFORE}'")).select("id", "path", "action")


@query(f"SELECT DISTINCT strftime(CAST(started_at AS TIMESTAMP), '%Y-%m-%d_%Hh%Mm%Ss') AS label FROM {LOG}")
def session_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of sessions that began with the attempts."""
    return views.attempts(spark, folder).select(exports.session_label(F.to_timestamp("started_at"), F.lit(0)).alias("label")).distinct()
