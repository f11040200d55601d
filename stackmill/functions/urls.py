"""URL parts and forms as column expressions.

Parts are taken with regular expressions rather than a URI parser: the same pattern runs in Spark
and in SQL engines, never throws, and accepts the characters that a strict parser rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of URL parts, limits, extensions of binary files and content types.
SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^\s*[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@\s]*@)?([^/?#:\s]+)"
PORT = r"^\s*[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@\s]*@)?[^/?#:\s]+:([0-9]+)"
PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)"
TAIL = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*[^?#]*(\?[^#]*)?(#.*)?$"
MAX_URL_BYTES = 2000
BINARY_EXTENSIONS = [".pdf", ".doc", ".docx", ".epub", ".zip", ".tar.gz", ".gz", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".rtf", ".ps", ".djvu", ".mobi"]
LOGIN_PATTERNS = ["/login", "/signin", "/sign-in", "/auth/", "/sso", "/cas/login", "/saml", "/oauth", "/openid", "/idp/"]
CONTENT_TYPE_EXTENSIONS = {"text/html": ".html", "text/plain": ".txt", "application/json": ".json", "application/xml": ".xml", "text/xml": ".xml", "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/svg+xml": ".svg", "application/zip": ".zip", "application/gzip": ".gz", "text/css": ".css", "text/javascript": ".js", "application/javascript": ".js", "video/mp4": ".mp4", "audio/mpeg": ".mp3"}


def _found(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) address; null otherwise."""
    return F.lower(_found(url, HOST))


def domain(url: Column) -> Column:
    """Host, or ``unknown``."""
    return F.coalesce(host(url), F.lit("unknown"))


def canonical_host(value: Column) -> Column:
    """A host without white space, leading ``www.`` and trailing dots, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^(www\.)+", ""), r"\.+$", ""))


def path(url: Column) -> Column:
    """Path of a URL; ``/`` when it is empty."""
    return F.coalesce(_found(url, PATH), F.lit("/"))


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` without a default port; null for anything but http(s)."""
    scheme, port = F.lower(_found(url, SCHEME)), _found(url, PORT)
    usual = F.when(scheme == "https", "443").otherwise("80")
    return F.when(host(url).isNotNull(), F.concat(scheme, F.lit("://"), host(url), F.when(port.isNotNull() & (port != usual), F.concat(F.lit(":"), port)).otherwise("")))


def canonical_url(url: Column) -> Column:
    """Address without fragment, in lower-case scheme and host, without default port and with a path.

    Text that is no http(s) address is only trimmed and cut at ``#``. Percent-encoding and IDN hosts
    stay as they are.
    """
    query = F.coalesce(F.regexp_extract(url, TAIL, 1), F.lit(""))
    return F.when(origin(url).isNotNull(), F.concat(origin(url), path(url), F.trim(query))).otherwise(F.regexp_replace(F.trim(url), "#.*$", ""))


def valid_url(url: Column) -> Column:
    """Within the length limit, http(s), with a host."""
    return (F.octet_length(url) <= MAX_URL_BYTES) & host(url).isNotNull()


def extension(url: Column) -> Column:
    """Lower-case extension of the last path segment, of 1 to 11 characters."""
    return F.lower(_found(path(url), r"(\.[^./]{1,11})$"))


def expects_binary(url: Column) -> Column:
    """The path ends in an extension of a binary file."""
    at = F.lower(path(url))
    ends = [at.endswith(e) for e in BINARY_EXTENSIONS]
    found = ends[0]
    for e in ends[1:]:
        found = found | e
    return F.coalesce(found, F.lit(False))


def login_domain(url: Column, content_type: Column, final_url: Column) -> Column:
    """Domain of the login page that a page came from where a binary file was expected; null when it did not.

    Only a login pattern in the final address counts: a page without one may be an error page.
    """
    page = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    pattern = F.exists(F.array(*map(F.lit, LOGIN_PATTERNS)), lambda p: F.contains(F.lower(final_url), p))
    return F.when(expects_binary(url) & page & F.coalesce(pattern, F.lit(False)), F.coalesce(host(final_url), host(url), F.lit("unknown")))


def referer(url: Column) -> Column:
    """The landing page a direct PDF link (``/doi/pdf/...``) belongs to, without its query; null for other links."""
    landing = F.concat(origin(url), F.regexp_replace(path(url), r"^/doi/pdf/", "/doi/"), F.coalesce(F.regexp_extract(url, TAIL, 2), F.lit("")))
    return F.when(path(url).startswith("/doi/pdf/"), landing)


def absolute(value: Column, base: Column) -> Column:
    """A link made absolute: as it is, scheme-relative to https, or joined to the base page.

    Joining follows the address standard: queries and fragments alone keep the page, ``.`` and ``..``
    are resolved, and a path above the root stays at it.
    """
    own, rest = F.regexp_extract(value, r"^([^?#]*)", 1), F.regexp_extract(value, r"^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path(base), r"[^/]*$", ""), own))
    parts = F.split(F.substring(joined, F.lit(2), F.length(joined)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.array_append(acc, p)))
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    place = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    query = F.coalesce(F.regexp_extract(base, TAIL, 1), F.lit(""))
    page = F.concat(path(base), F.when(rest.startswith("?"), "").otherwise(query), rest)
    return F.when(value.rlike(r"^https?://"), value).when(value.startswith("//"), F.concat(F.lit("https:"), value)).when(origin(base).isNotNull(), F.concat(origin(base), F.when(own == "", page).otherwise(F.concat(place, rest))))


def host_or_text(value: Column) -> Column:
    """The canonical host of an address, or of text that is a host itself."""
    return canonical_host(F.coalesce(host(value), value))


def hosts_match(a: Column, b: Column) -> Column:
    """Both mean one host, whatever their ``www.``, letter case and trailing dots."""
    return host_or_text(a) == host_or_text(b)


def fallback_filename(url: Column, epoch: Column) -> Column:
    """The last segment of the path with characters replaced that no file system takes, else a name with the time."""
    last = F.nullif(F.regexp_extract(path(url), r"([^/]*)$", 1), F.lit(""))
    return F.coalesce(safe_filename(last), F.concat(F.lit("download_"), epoch.cast("string"), F.lit(".bin")))


def safe_filename(name: Column) -> Column:
    """A name without separators, wildcards and control characters; never empty, ``.`` or ``..``."""
    plain = F.regexp_replace(name, r"[/\\:*?\"<>|\p{Cc}]", "_")
    return F.when(plain == "", "_").when(plain.isin(".", ".."), F.replace(plain, F.lit("."), F.lit("_"))).otherwise(plain)


def host_within(url: Column, wanted: Column | str) -> Column:
    """The host is ``wanted`` or below it; for text without a host, whether it occurs in it."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return F.when(host(url).isNull(), F.contains(F.lower(url), wanted)).otherwise((host(url) == wanted) | F.endswith(host(url), F.concat(F.lit("."), wanted)))


def clean_domain_filter(value: str) -> str:
    """A typed domain without white space and leading dots, in lower case; empty means no filter."""
    return value.strip().lstrip(".").strip().lower()


def content_type_extension(content_type: Column) -> Column:
    """Extension for a content type; ``.bin`` when unknown."""
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPE_EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))), F.lit(".bin"))


def disposition_filename(header: Column) -> Column:
    """File name of a Content-Disposition header, the encoded form first; a quotation mark that is not closed gives none."""
    encoded = F.regexp_extract(header, r"filename\*=[^']*''([^;]*)", 1)
    decoded = F.when(header.rlike(r"filename\*=[^']*''"), F.try_url_decode(F.regexp_replace(F.trim(encoded), r"\+", "%2B")))
    quoted = F.when(header.rlike(r'filename=\s*"[^"]*"'), F.regexp_extract(header, r'filename=\s*"([^"]*)"', 1))
    return F.coalesce(decoded, quoted, F.nullif(F.trim(_found(header, r'filename=\s*([^";][^;]*)')), F.lit("")))
