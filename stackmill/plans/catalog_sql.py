"""DuckDB SQL that says the same as the queries of ``catalog``."""

from __future__ import annotations

from stackmill.functions import identifiers, urls

LOG = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logged_at DESC) AS rn FROM download_log) WHERE rn = 1)"
QUEUE = "(SELECT * REPLACE (CASE WHEN status IN ('pending', 'in_progress', 'completed', 'failed') THEN status ELSE 'pending' END AS status) FROM queue_items)"
COLUMNS = "id, url, status, project, started_at, error_type, retry_count"


def _get(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def host(column: str) -> str:
    return f"lower({_get(column, urls.HOST)})"


def path(column: str) -> str:
    return f"coalesce({_get(column, urls.PATH)}, '/')"


def origin(column: str) -> str:
    scheme, port = f"lower({_get(column, urls.SCHEME)})", _get(column, urls.PORT)
    return f"CASE WHEN {host(column)} IS NOT NULL THEN {scheme} || '://' || {host(column)} || CASE WHEN {port} IS NOT NULL AND {port} <> CASE WHEN {scheme} = 'https' THEN '443' ELSE '80' END THEN ':' || {port} ELSE '' END END"


def canonical(column: str) -> str:
    query = f"coalesce(regexp_extract({column}, '{urls.TAIL}', 1), '')"
    return f"CASE WHEN {host(column)} IS NOT NULL THEN {origin(column)} || {path(column)} || trim({query}) ELSE regexp_replace(trim({column}), '#.*$', '') END"


def extension(column: str) -> str:
    return f"lower(nullif(regexp_extract({path(column)}, '(\\.[^./]{{1,11}})$', 1), ''))"


def stripped(value: str) -> str:
    return f"regexp_replace({value}, '{identifiers.EDGES}', '', 'g')"


def registry_doi(column: str) -> str:
    bare = f"regexp_replace(regexp_replace({stripped(column)}, '^(?i)https?://(?:dx\\.)?doi\\.org/', ''), '^(?i)doi:\\s*', '')"
    return f"nullif(lower({stripped(f'url_decode({bare})')}), '')"


def dedup_key(doi: str, url: str) -> str:
    return f"coalesce('doi:' || {registry_doi(doi)}, 'url:' || nullif({canonical(url)}, ''))"


def status_class(column: str) -> str:
    return f"CASE WHEN {column} IN (401, 403, 407) THEN 'needs_auth' WHEN {column} = 429 THEN 'rate_limited' WHEN {column} = 408 OR {column} BETWEEN 500 AND 599 THEN 'transient' ELSE 'permanent' END"


def within(column: str, domain: str) -> str:
    return f"CASE WHEN {host(column)} IS NULL THEN contains(lower({column}), '{domain}') ELSE {host(column)} = '{domain}' OR {host(column)} LIKE '%.{domain}' END"


MESSAGE_CLASS = "CASE WHEN regexp_matches(m, '^\\[AUTH\\]') THEN 'auth' WHEN m LIKE '%HTTP 404%' THEN 'input_source' WHEN m LIKE '%timeout%' OR m LIKE '%network error%' THEN 'network' WHEN m LIKE '%invalid URL%' OR m LIKE '%invalid DOI%' OR m LIKE '%could not parse reference%' THEN 'input_source' ELSE 'other' END"
TYPE_CLASS = "CASE error_type WHEN 'auth' THEN 'auth' WHEN 'not_found' THEN 'input_source' WHEN 'parse_error' THEN 'input_source' WHEN 'network' THEN 'network' END"
TYPE_WHAT = "CASE WHEN error_type = 'auth' AND http_status = 407 THEN 'Proxy authentication required' WHEN error_type = 'auth' THEN 'Authentication required' WHEN error_type = 'not_found' THEN 'Source not found' WHEN error_type = 'parse_error' THEN 'Input could not be parsed' WHEN error_type = 'network' THEN 'Network request failed' END"
REQUESTS = "(SELECT 'host' || (user_id % 50) || '.example' AS domain, event_id AS id, epoch_us(ts) // 1000 AS arrived_ms FROM events)"


def schedule(delay: int) -> str:
    return f"(SELECT domain, id, arrived_ms, CAST(max(arrived_ms - rn * {delay}) OVER (PARTITION BY domain ORDER BY arrived_ms, id ROWS UNBOUNDED PRECEDING) + rn * {delay} AS BIGINT) AS start_ms FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY arrived_ms, id) - 1 AS rn FROM {REQUESTS}))"


def file_name(column: str) -> str:
    return f"nullif(regexp_extract({column}, '([^/]+)/*$', 1), '')"


TOPICS = "list_sort(list_distinct(list_filter(list_transform(coalesce(try_cast(try_cast(topics AS JSON) AS VARCHAR[]), []), lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '')))"
_BIBLIOGRAPHY = "WITH b AS (SELECT CAST(c_custkey AS BIGINT) AS input_id, CAST(i AS INT) AS entry_no, CASE i WHEN 1 THEN 'Smith, J. (2001). First of ' || c_name || '. Press.' WHEN 2 THEN 'Jones, K. (2002). Second, a journal.' WHEN 3 THEN 'Brown, L. (2003). Third ' || c_custkey || ' wrapped line.' WHEN 4 THEN 'Green, M. (2004). Fourth. End. 12.' ELSE 'foo, bar, baz, qux, quux, corge' END AS entry FROM customer, range(1, 7) r(i) WHERE i <> 5)"
CITATION = "SELECT c_custkey AS input_id, c_custkey % 4 AS k, 1900 + c_custkey % 120 AS y FROM customer"
_PREFIX_RULES = "CASE p_partkey % 10 WHEN 0 THEN 'ieee' WHEN 1 THEN 'oxford' WHEN 2 THEN 'springer' WHEN 3 THEN 'sciencedirect' WHEN 4 THEN 'acm' WHEN 5 THEN 'wiley' WHEN 6 THEN 'wiley' WHEN 7 THEN 'mdpi' WHEN 8 THEN 'arxiv' ELSE 'crossref' END"
_PAGE_RULES = "CASE p_partkey % 10 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'ieee' WHEN 2 THEN 'oxford' WHEN 3 THEN 'springer' WHEN 4 THEN 'sciencedirect' WHEN 5 THEN 'acm' WHEN 6 THEN 'wiley' WHEN 7 THEN 'mdpi' WHEN 8 THEN 'youtube' ELSE 'pubmed' END"
_COMPONENT = "trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}}.\\-]+', '_', 'g'), '_')"
_FIRST_AUTHOR = "trim(split_part(authors, ';', 1))"
_FAMILY = f"coalesce(nullif(trim(split_part({_FIRST_AUTHOR}, ',', 1)), ''), {_FIRST_AUTHOR})"
_AUTHORS = "CASE WHEN coalesce(trim({0}), '') = '' THEN [] WHEN contains({0}, ';') THEN list_filter(list_transform(string_split({0}, ';'), lambda p: trim(p)), lambda p: p <> '') WHEN len(list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> '')) > 1 AND len(list_filter(list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> ''), lambda p: NOT regexp_matches(p, '\\s'))) = 0 THEN list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> '') ELSE [trim({0})] END"
_CORPUS = f"SELECT 'c/' || lpad(CAST(meta_id AS VARCHAR), 9, '0') || '.json' AS path, title, {_AUTHORS.format('authors')} AS a, year AS d, doi FROM queue_metadata"
_YEAR = "CASE WHEN regexp_matches(trim(split_part(d, '-', 1)), '^[0-9]{4}$') THEN trim(split_part(d, '-', 1)) END"
_ESC = "regexp_replace({}, '([&%$#])', '\\\\\\1', 'g')"
_LAST = "lower(CASE WHEN contains(a[1], ',') THEN trim(split_part(trim(a[1]), ',', 1)) ELSE regexp_extract(trim(a[1]), '(\\S*)$', 1) END)"
_SKIP = f"({within('url', 'archive.slowmaterials.example')} OR {within('url', 'tides.example')})"


def truncated(value: str, most: int) -> str:
    return f"CASE WHEN length({value}) > {most} THEN left({value}, {most - 1}) || '…' ELSE {value} END"


def _plain(column: str) -> str:
    return "lower(trim(regexp_replace(" + column + ", '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g')))"


def _ascii(column: str) -> str:
    """Every character outside ASCII as one that is in no query: distances to an ASCII query stay, counted in characters."""
    return f"regexp_replace({column}, '[^\\x00-\\x7F]', chr(1), 'g')"


_FUZZY = f"greatest(1 - levenshtein('granular', {_ascii('t')}) / greatest(8, length(t)), coalesce(list_max(list_transform(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), lambda w: 1 - levenshtein('granular', {_ascii('w')}) / greatest(8, length(w)))), 0))"
RANKED = f"""WITH c AS (SELECT id, title, authors, doi, started_at, file_path FROM {LOG} WHERE coalesce(title, authors, doi) IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 10000),
        f AS (SELECT id, 0 AS r, 'title' AS field, {_plain('title')} AS t FROM c UNION ALL SELECT id, -1, 'authors', {_plain('authors')} FROM c UNION ALL SELECT id, -2, 'doi', {_plain('doi')} FROM c),
        z AS (SELECT *, {_FUZZY} AS fuzzy FROM f WHERE t IS NOT NULL AND t <> ''),
        m AS (SELECT *, CASE WHEN t = 'granular' THEN 3 WHEN contains(t, 'granular') THEN 2 WHEN fuzzy >= 0.86 THEN 1 END AS kind, CASE WHEN t = 'granular' THEN 1.0 WHEN contains(t, 'granular') THEN 8 / length(t) ELSE fuzzy END AS sim FROM z),
        b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind DESC, sim DESC, r DESC) AS n FROM m WHERE kind IS NOT NULL)
        SELECT b.id, kind AS match_kind, round(sim, 6) AS similarity, field AS matched_field, title, file_path, started_at FROM b JOIN c ON c.id = b.id WHERE n = 1 ORDER BY kind DESC, sim DESC, started_at DESC, b.id DESC LIMIT 200"""
CORPUS_BIBTEX = f"SELECT path, '@article{{' || k || ',' || chr(10) || f || CASE WHEN f <> '' THEN chr(10) ELSE '' END || '}}' AS entry FROM (SELECT path, lower(regexp_replace(coalesce(nullif(coalesce({_LAST}, '') || coalesce({_YEAR}, ''), ''), regexp_replace(path[3:], '\\.[^.]*$', '')), '[^A-Za-z0-9_\\-]', '', 'g')) AS k, concat_ws(',' || chr(10), '  title     = {{' || {_ESC.format('title')} || '}}', CASE WHEN len(a) > 0 THEN '  author    = {{' || {_ESC.format(chr(97) + 'rray_to_string(a, ' + chr(39) + ' and ' + chr(39) + ')')} || '}}' END, '  year      = {{' || {_YEAR} || '}}', '  doi       = {{' || {_ESC.format('doi')} || '}}') AS f FROM ({_CORPUS}))"
_PEOPLE = "list_filter(" + _AUTHORS.format("meta_authors") + ", lambda n: n IS NOT NULL)"
_SIDECAR = f"""SELECT id, '{{' || concat_ws(',', '"@context":"https://schema.org"', '"@type":"ScholarlyArticle"', '"name":' || CAST(to_json(nullif({stripped('meta_title')}, '')) AS VARCHAR), CASE WHEN len({_PEOPLE}) > 0 THEN '"author":[' || array_to_string(list_transform({_PEOPLE}, lambda n: '{{"@type":"Person","name":' || CAST(to_json(n) AS VARCHAR) || '}}'), ',') || ']' END, '"datePublished":' || CAST(to_json(nullif({stripped('meta_year')}, '')) AS VARCHAR), '"identifier":{{"@type":"PropertyValue","propertyID":"DOI","value":' || CAST(to_json(nullif({stripped('meta_doi')}, '')) AS VARCHAR) || '}}', '"url":' || CAST(to_json(nullif({stripped('url')}, '')) AS VARCHAR)) || '}}' AS document FROM {QUEUE} WHERE status = 'completed'"""
ORACLE_SQL: dict[str, str] = {
    "log_recent": f"SELECT {COLUMNS} FROM {LOG} ORDER BY id DESC LIMIT 200",
    "log_by_status": f"SELECT {COLUMNS} FROM {LOG} WHERE status = 'failed' ORDER BY id DESC LIMIT 50",
    "log_by_project": f"SELECT {COLUMNS} FROM {LOG} WHERE project = 'basalt-corpus' ORDER BY id DESC LIMIT 10000",
    "log_since_until": f"SELECT {COLUMNS} FROM {LOG} WHERE started_at >= '2022-03-01 00:00:00' AND started_at <= '2022-09-30 23:59:59' ORDER BY id DESC LIMIT 10000",
    "log_keyset_page": f"SELECT {COLUMNS} FROM {LOG} WHERE id > 100 AND id < 2000 ORDER BY id DESC LIMIT 100",
    "log_by_domain": f"SELECT {COLUMNS} FROM {LOG} WHERE {within('url', 'loomstudies.test')} ORDER BY id DESC LIMIT 100",
    "log_uncertain": f"SELECT {COLUMNS} FROM {LOG} WHERE parse_confidence = 'low' ORDER BY id DESC LIMIT 500",
    "log_confidence_json": f"SELECT CAST(f->>'has_authors' AS BOOLEAN) AS has_authors, CAST(f->>'has_year' AS BOOLEAN) AS has_year, CAST(f->>'has_title' AS BOOLEAN) AS has_title, count(*) AS attempts, CAST(sum(CAST(f->>'author_count' AS BIGINT)) AS BIGINT) AS authors FROM (SELECT CAST(parse_confidence_factors AS JSON) AS f FROM {LOG} WHERE parse_confidence_factors IS NOT NULL) GROUP BY 1, 2, 3",
    "log_multi_source": f"SELECT source, id, started_at, status, (SELECT count(*) FROM download_log) > 100 AS truncated FROM (SELECT *, coalesce(project, '') AS source FROM {LOG}) ORDER BY started_at DESC, id DESC, source LIMIT 100",
    "log_failed_described": f"SELECT id, coalesce({TYPE_CLASS}, CASE WHEN m IS NOT NULL THEN {MESSAGE_CLASS} END, 'other') AS category, coalesce({TYPE_WHAT}, 'Unhandled failure') AS what FROM (SELECT *, error_message AS m FROM {LOG}) WHERE status = 'failed'",
    "log_latest_id": "SELECT max(id) AS latest_id FROM download_log",
    "log_status_class": f"SELECT {status_class('http_status')} AS class, {MESSAGE_CLASS} AS by_message, count(*) AS attempts FROM (SELECT *, coalesce(error_message, '') AS m FROM {LOG}) WHERE status = 'failed' GROUP BY 1, 2",
    "search_candidates": f"SELECT id, status, title, started_at FROM {LOG} WHERE coalesce(title, authors, doi) IS NOT NULL AND started_at >= '2022-02-01 00:00:00' AND status = 'success' AND file_path IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 1000",
    "search_ranked": f"SELECT id, match_kind, similarity, matched_field FROM ({RANKED})",
    "queue_claim_batch": f"SELECT id, priority, created_at FROM {QUEUE} WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 25",
    "queue_counts": f"SELECT project, status, count(*) AS items FROM {QUEUE} GROUP BY 1, 2",
    "queue_legacy_unscoped": "SELECT count(*) FILTER (WHERE project IS NULL) AS unscoped FROM queue_items",
    "queue_list_by_status": f"SELECT id, priority, created_at, project FROM {QUEUE} WHERE status = 'failed'",
    "queue_reset_in_progress": f"SELECT project, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, count(*) AS items FROM {QUEUE} GROUP BY 1, 2",
    "queue_fold_state": f"SELECT url, status, retry_count FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS n FROM {LOG}) WHERE n = 1 AND status <> 'removed'",
    "queue_has_active_url": f"SELECT id FROM {LOG} AS l WHERE EXISTS (SELECT 1 FROM {QUEUE} AS q WHERE q.status IN ('pending', 'in_progress') AND q.url = l.url AND coalesce(q.project, '') = coalesce(l.project, ''))",
    "new_completed_anti": f"SELECT id FROM {QUEUE} WHERE status = 'completed' AND id NOT IN (SELECT id FROM queue_items WHERE status = 'completed' AND updated_at < '2022-06-01 00:00:00')",
    "dedup_registry_lookup": f"WITH k AS (SELECT {dedup_key('doi', 'url')} AS key, bool_or(file_path LIKE '%.pdf') AS present FROM {LOG} WHERE status = 'success' GROUP BY 1), q AS (SELECT id, 'doi:' || {registry_doi('meta_doi')} AS dk, 'url:' || nullif({canonical('url')}, '') AS uk FROM queue_items) SELECT id, CASE WHEN coalesce(a.present, false) OR coalesce(b.present, false) THEN 'hit' WHEN coalesce(a.present, b.present) IS NOT NULL THEN 'stale' ELSE 'miss' END AS outcome FROM q LEFT JOIN k a ON a.key = q.dk LEFT JOIN k b ON b.key = q.uk",
    "registry_upsert": f"WITH d AS (SELECT {dedup_key('doi', 'url')} AS dedup_key, file_path, started_at FROM {LOG} WHERE status = 'success' AND file_path IS NOT NULL) SELECT dedup_key, (max(struct_pack(s := started_at, p := file_path))).p AS relative_path, min(started_at) AS first_seen_at, max(started_at) AS last_seen_at FROM d WHERE dedup_key IS NOT NULL GROUP BY 1",
    "url_hosts": f"SELECT coalesce({host('url')}, 'unknown') AS host, count(*) AS items FROM queue_items GROUP BY 1",
    "url_canonical": f"SELECT id, {canonical('url')} AS canonical FROM queue_items",
    "url_origin": f"SELECT {origin('url')} AS origin, count(*) AS n FROM download_log GROUP BY 1",
    "url_extension": f"SELECT {extension('url')} AS extension, coalesce(regexp_matches(lower({path('url')}), '(\\.pdf|\\.docx?|\\.epub|\\.zip|\\.tar\\.gz|\\.gz|\\.xlsx?|\\.pptx?|\\.odt|\\.ods|\\.odp|\\.rtf|\\.ps|\\.djvu|\\.mobi)$'), false) AS \"binary\", count(*) AS n FROM download_log GROUP BY 1, 2",
    "url_dedup_key": f"SELECT id, {dedup_key('meta_doi', 'url')} AS dedup_key FROM queue_items",
    "doi_forms": f"SELECT id, p AS parsed, {registry_doi('meta_doi')} AS registered, regexp_replace({stripped('meta_doi')}, '^(?i)(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', '') AS logged, regexp_matches(p, '^10\\.[0-9]{{4,}}(?:\\.[^/]*)?/.+') AS valid FROM (SELECT id, meta_doi, {stripped("url_decode(regexp_replace(regexp_replace(" + stripped("meta_doi") + ", '^https?://(?:dx[.])?doi[.]org/', ''), '^(?i)doi:[[:space:]]*', ''))")} AS p FROM queue_items WHERE meta_doi IS NOT NULL)",
    "content_types": "SELECT CASE lower(trim(split_part(content_type, ';', 1))) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.CONTENT_TYPE_EXTENSIONS.items()) + " ELSE '.bin' END AS extension, count(*) AS n FROM download_log GROUP BY 1",
    "failure_summary": f"SELECT coalesce({TYPE_CLASS}, CASE WHEN m IS NOT NULL THEN {MESSAGE_CLASS} END, 'other') AS category, count(*) AS failures, count(DISTINCT coalesce({host('url')}, 'unknown')) AS domains FROM (SELECT *, error_message AS m FROM {LOG}) WHERE status = 'failed' GROUP BY 1",
    "failure_auth_domains": f"SELECT coalesce({host('url')}, 'unknown') AS domain, count(*) AS failures FROM {LOG} WHERE error_type = 'auth' GROUP BY 1",
    "http_status_class": f"SELECT http_status, {status_class('http_status')} AS class, CASE WHEN http_status IN (401, 403, 407) THEN 'auth' WHEN http_status = 404 THEN 'not_found' ELSE 'network' END AS error_type, count(*) AS n FROM {LOG} WHERE http_status IS NOT NULL GROUP BY ALL",
    "retry_schedule": f"WITH f AS (SELECT id, {status_class('coalesce(http_status, 503)')} AS c FROM {LOG} WHERE status = 'failed') SELECT id, CAST(a AS INT) AS attempt, CASE WHEN a = 1 THEN 0 ELSE CAST(least(1000 * pow(2, a - 2), 32000) AS BIGINT) END AS delay_ms FROM f, range(1, 7) r(a) WHERE a = 1 OR c IN ('transient', 'rate_limited')",
    "retry_after_parse": f"SELECT id, CASE id % 5 WHEN 0 THEN least(id * 7, 3600) WHEN 1 THEN NULL WHEN 2 THEN 90 WHEN 3 THEN NULL ELSE 30 END AS wait_s FROM {LOG}",
    "rate_limit_schedule": f"SELECT * FROM {schedule(60_000)}",
    "rate_limit_cumulative": f"SELECT domain, count(*) AS requests, CAST(sum(start_ms - arrived_ms) AS BIGINT) AS waited_ms, sum(start_ms - arrived_ms) >= 30000 AS warned FROM {schedule(600_000)} GROUP BY 1",
    "robots_allowed": f"SELECT id FROM (SELECT id, url, {origin('url')} AS o, {path('url')} AS p FROM queue_items) WHERE NOT coalesce(starts_with(p, CASE WHEN length(o) % 2 = 0 THEN '/handle' ELSE '/article' END) AND o IS NOT NULL, false)",
    "cookie_netscape_parse": "SELECT CASE c_custkey % 7 WHEN 1 THEN 'flag is neither TRUE nor FALSE' WHEN 2 THEN 'expiry is no number' WHEN 3 THEN 'no name' END AS problem, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 7 NOT IN (1, 2, 3) THEN c_custkey * 1000 END) AS BIGINT) AS expires FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1",
    "cookie_domain_status": "WITH c AS (SELECT 'd' || c_nationkey || '.example' AS domain, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 100 END AS e FROM customer) SELECT domain, count(*) AS cookies, CASE WHEN bool_or(e > 60000) THEN 'valid' WHEN bool_or(e = 0) THEN 'session' ELSE 'expired' END AS validity FROM c GROUP BY 1",
    "html_meta_tags": f"SELECT bib_id, {stripped('coalesce(title, chr(32))')} AS title, coalesce(doi, 'none') AS doi, CASE WHEN key = entry_type THEN key ELSE key || '|' || entry_type END AS authors FROM (SELECT bib_id, nullif(title, '') AS title, doi, key, entry_type FROM bibtex_entries)",
    "html_title": f"SELECT bib_id, nullif({stripped('title')}, '') AS title, '/files/' || bib_id || '.pdf' AS pdf FROM bibtex_entries",
    "crossref_metadata": "SELECT work_doi AS doi, 'Work ' || work_doi AS title, string_agg(concat_ws(', ', family, given), '; ' ORDER BY fetched_at, seq, row_id) AS authors, '2001' AS year FROM crossref_authors WHERE work_doi IS NOT NULL GROUP BY 1",
    "crossref_pdf_pick": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://x.example/b' WHEN 1 THEN 'https://x.example/c' WHEN 2 THEN 'https://x.example/a' END AS pdf FROM part",
    "open_pdf_pick": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://repo.example/x' WHEN 2 THEN 'https://arxiv.org/pdf/2101.00001.pdf' ELSE 'https://publisher.example/p' END AS pdf FROM part",
    "mdpi_store_url": "SELECT p_partkey, 'https://mdpi-res.com/d_attachment/electronics/' || s || '/article_deploy/' || s || '.pdf' AS url FROM (SELECT p_partkey, 'electronics-' || (p_partkey % 30 + 1) || '-' || CASE WHEN length('9' || p_partkey) < 5 THEN lpad('9' || p_partkey, 5, '0') ELSE '9' || p_partkey END AS s FROM part)",
    "cookie_headers": "SELECT c_custkey, concat_ws('; ', c_name || '=v', 'Domain=.d' || c_nationkey || '.example', 'Path=/p', CASE WHEN c_custkey % 2 = 0 THEN 'Secure' END, CASE WHEN c_custkey % 3 > 0 THEN 'Expires=' || strftime(to_timestamp((c_custkey % 3) * 86400000) AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S') || ' GMT' END) AS header, CASE WHEN c_custkey % 2 = 0 THEN 'https://d' ELSE 'http://d' END || c_nationkey || '.example/p' AS origin FROM customer",
    "parse_urls": "SELECT p_partkey AS input_id, 'https://h.example/a_(' || p_partkey || ')' AS value FROM part",
    "parse_dois": "SELECT p_partkey AS input_id, CAST(1 AS INT) AS ord, '10.5555/Part(' || p_partkey || ')' AS value FROM part",
    "parse_summary": "SELECT 'Parsed ' || (2 * p + c) || ' items: ' || p || ' URLs, ' || p || ' DOIs, ' || c || ' references, 0 BibTeX [reference confidence: high=' || h || ', medium=' || (c - h) || ', low=0]' AS summary FROM (SELECT count(*) AS p FROM part), (SELECT count(*) AS c, count(*) FILTER (WHERE c_custkey % 4 IN (0, 3)) AS h FROM customer)",
    "resolver_route": f"SELECT p_partkey * 3 AS id, {_PREFIX_RULES} AS rule FROM part UNION ALL SELECT p_partkey * 3 + 1, {_PAGE_RULES} FROM part UNION ALL SELECT p_partkey * 3 + 2, CASE p_partkey % 3 WHEN 0 THEN 'pubmed' END FROM part",
    "queue_route": "SELECT k AS kind, CASE WHEN k = 'url' THEN CASE WHEN url IS NOT NULL THEN 'direct' END WHEN k = 'doi' THEN 'crossref' END AS rule, count(*) AS items FROM (SELECT CASE source_type WHEN 'direct_url' THEN 'url' ELSE source_type END AS k, url FROM queue_items) GROUP BY 1, 2",
    "resolver_redirect_chase": "SELECT p_partkey, 'https://r.example/' || (p_partkey - p_partkey % 8) AS final_url, CAST(p_partkey % 8 AS INT) AS hops FROM part",
    "parse_known_ids": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'PMC' || n WHEN 1 THEN '2101.' || n WHEN 2 THEN '2101.' || n || 'v2' WHEN 3 THEN 'PMID:' || n END AS known FROM (SELECT p_partkey, lpad(CAST(p_partkey + 10000 AS VARCHAR), 5, '0') AS n FROM part)",
    "reference_confidence": f"SELECT input_id, CASE WHEN k = 1 THEN '' ELSE 'Smith, J.' END AS authors, CASE WHEN k <> 2 THEN CAST(y AS INT) END AS year, CASE WHEN k IN (0, 3) THEN 'high' ELSE 'medium' END AS confidence FROM ({CITATION})",
    "confidence_distribution": f"SELECT CASE WHEN k IN (0, 3) THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM ({CITATION}) GROUP BY 1",
    "bibliography_segments": f"{_BIBLIOGRAPHY} SELECT input_id, entry_no, entry FROM b",
    "bibliography_summary": f"{_BIBLIOGRAPHY} SELECT count(*) AS found, count(*) FILTER (WHERE entry_no < 5) AS parsed, count(*) FILTER (WHERE entry_no > 5) AS uncertain FROM b",
    "ris_parse": "SELECT ris_id, entry_type, trim(title) AS title, coalesce(trim(authors), '') AS authors, year, doi, url, CAST(NULL AS VARCHAR) AS problem FROM ris_entries",
    "ris_items": "WITH e AS (SELECT ris_id, coalesce(doi, url) AS v, CASE WHEN doi IS NOT NULL THEN 'doi' ELSE 'url' END AS k, nullif(concat_ws(' ', nullif(trim(authors), ''), '(' || year || ')', CASE WHEN trim(title) LIKE '%.' THEN trim(title) WHEN trim(title) <> '' THEN trim(title) || '.' END), '') AS said FROM ris_entries) SELECT ris_id, CAST(1 AS INT) AS ord, k AS kind, v AS value FROM e WHERE v IS NOT NULL UNION ALL SELECT ris_id, CASE WHEN v IS NULL THEN 1 ELSE 2 END, 'reference', said FROM e WHERE said IS NOT NULL",
    "bibtex_parse": "SELECT bib_id, entry_type, key, trim(title) AS title, array_to_string(list_filter(list_transform(string_split_regex(author, '(?i)\\s+and\\s+'), lambda a: trim(a)), lambda a: a <> ''), ', ') AS authors, year, doi, CAST(NULL AS VARCHAR) AS problem FROM bibtex_entries",
    "md_links_distinct": "WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>\"'']+', 0)) AS raw FROM documents) SELECT min(doc_id) AS doc_id, url FROM (SELECT doc_id, regexp_replace(raw, '[.,;:!?)\\]}]+$', '') AS url FROM l) GROUP BY url",
    "topics_normalize": f"SELECT meta_id, array_to_string({TOPICS}, '|') AS topics FROM queue_metadata",
    "topics_match_custom": f"WITH t AS (SELECT meta_id, {TOPICS} AS t FROM queue_metadata), p AS (SELECT meta_id, t, list_transform(t, lambda x: list_filter(['frost', 'the cable hum of masts', 'tidal'], lambda c: contains(x, c) OR contains(c, x))[1]) AS m FROM t) SELECT meta_id, array_to_string(list_concat(list_filter(['frost', 'the cable hum of masts', 'tidal'], lambda c: list_contains(m, c)), list_filter(t, lambda x: len(list_filter(['frost', 'the cable hum of masts', 'tidal'], lambda c: contains(x, c) OR contains(c, x))) = 0)), '|') AS topics FROM p",
    "filename_preferred": f"SELECT id, coalesce(nullif({_COMPONENT.format(_FAMILY)}, '') || '_2020_' || left(nullif({_COMPONENT.format('title')}, ''), 60) || coalesce({extension('url')}, '.bin'), {_COMPONENT.format('replace(coalesce(' + host('url') + chr(44) + chr(39) + 'unknown' + chr(39) + '), ' + chr(39) + '.' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ')')} || '_1700000000' || coalesce({extension('url')}, '.bin')) AS filename FROM {LOG} WHERE status = 'success'",
    "filename_unique": "WITH q AS (SELECT id, coalesce(project, '') AS project, suggested_filename AS f, row_number() OVER (PARTITION BY coalesce(project, ''), suggested_filename ORDER BY id) - 1 AS n FROM queue_items WHERE suggested_filename IS NOT NULL), s AS (SELECT *, regexp_extract(f, '^(.*?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(f, '(\\.[^.]*)$', 1) AS e FROM q), g AS (SELECT DISTINCT project, f FROM s), c AS (SELECT s.id, s.n, k.k FROM s JOIN (SELECT project, stem, e, max(n) AS most FROM s GROUP BY ALL) m USING (project, stem, e), range(1, 400) k(k) WHERE s.n > 0 AND NOT EXISTS (SELECT 1 FROM g WHERE g.project = s.project AND g.f = s.stem || '_' || k.k || s.e)), p AS (SELECT id, n, k, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM c) SELECT s.id, CASE WHEN s.n = 0 THEN s.f ELSE s.stem || '_' || p.k || s.e END AS filename FROM s LEFT JOIN p ON p.id = s.id AND p.r = s.n WHERE s.n = 0 OR p.k IS NOT NULL",
    "project_sanitize": "WITH p AS (SELECT project, label || CASE WHEN length(project) % 2 = 0 THEN ' / aux?' ELSE '/con' END AS l FROM projects) SELECT project, trim(regexp_replace(trim(l), '[/\\\\:*?\"<>|\\s-]+', '-', 'g'), '-') AS name, trim(regexp_replace(trim(split_part(l, '/', 1)), '[/\\\\:*?\"<>|\\s-]+', '-', 'g'), '-') || CASE WHEN length(project) % 2 = 0 THEN '/aux-project' ELSE '/con-project' END AS folder FROM p",
    "export_bibtex": CORPUS_BIBTEX,
    "export_ris": f"SELECT path, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, CASE WHEN len(a) > 0 THEN array_to_string(list_transform(a, lambda x: 'AU  - ' || x), chr(10)) END, 'PY  - ' || {_YEAR}, 'DO  - ' || doi, 'ER  - ' || chr(10)) AS entry FROM ({_CORPUS})",
    "sidecar_roundtrip": f"SELECT 'c/' || id || '.json' AS path, nullif({stripped('meta_title')}, '') AS title, CAST(len({_AUTHORS.format('meta_authors')}) AS INT) AS authors, nullif({stripped('meta_year')}, '') AS date, nullif({stripped('meta_doi')}, '') AS doi, nullif({stripped('url')}, '') AS url FROM {QUEUE} WHERE status = 'completed'",
    "project_topics": f"SELECT project, array_to_string(list_sort(list_distinct(list(t))), '|') AS topics FROM (SELECT project, unnest({TOPICS}) AS t FROM {QUEUE} WHERE status = 'completed') GROUP BY 1",
    "convert_eligible": f"WITH l AS (SELECT *, regexp_replace(file_path, '\\.[^./]*$', '') AS stem FROM {LOG} WHERE status = 'success'), c AS (SELECT regexp_replace(saved_path, '\\.[^./]*$', '') AS stem, bool_or({host('url')} IS NOT NULL AND {_SKIP}) AS useless FROM {QUEUE} WHERE status = 'completed' AND saved_path IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM l AS p WHERE p.content_type = 'application/pdf' AND p.stem = l.stem) THEN 'keep' WHEN coalesce(c.useless, false) THEN 'skip' ELSE 'convert' END AS action FROM l LEFT JOIN c ON c.stem = l.stem WHERE content_type IN ('text/html', 'application/octet-stream')",
    "stream_rate_limiter": f"SELECT * FROM {schedule(60_000)}",
    "stream_progress": "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, m GROUP BY 1, 2, date_trunc('day', ts), w HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= w",
    "stream_snapshot": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "sidecar_json": _SIDECAR,
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
