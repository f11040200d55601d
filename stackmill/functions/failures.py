"""Classes of failures with their reasons and remedies, retry delays and Retry-After values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class, what happened, and the pattern of the message, in the order they are tried.
MESSAGE_RULES = [
    ("auth", "Proxy authentication required", r"^\[AUTH\][\s\S]*\(HTTP 407\)"),
    ("auth", "Authentication required", r"^\[AUTH\]"),
    ("input_source", "Source not found", r"HTTP 404"),
    ("network", "Download timed out", r"timeout"),
    ("network", "Network request failed", r"network error"),
    ("input_source", "Input could not be parsed", r"invalid URL|invalid DOI|could not parse reference"),
]
TYPE_RULES = {"auth": ("auth", "Authentication required"), "not_found": ("input_source", "Source not found"), "parse_error": ("input_source", "Input could not be parsed"), "network": ("network", "Network request failed")}
OTHER = ("other", "Unhandled failure")
#: Why it happens and what to do, by what happened.
REMEDIES = {
    "Proxy authentication required": ("The proxy refuses requests without valid credentials.", "Check the proxy settings and credentials."),
    "Authentication required": ("The source gives access only to a logged-in session.", "Capture the cookies of a logged-in session and retry."),
    "Source not found": ("The address does not lead to a file any more.", "Check the address, DOI or reference and retry with a current one."),
    "Download timed out": ("The host did not answer in time.", "Raise the number of retries or check the network."),
    "Network request failed": ("Connection, name lookup, TLS or VPN broke the request off.", "Check the connection and VPN settings, then retry."),
    "Input could not be parsed": ("The address, DOI or reference could not be read safely.", "Check the form of the input and retry."),
    "Unhandled failure": ("The message fits no known class.", "Look at the log and rerun; what is open stays in the queue."),
}
#: Of each class, in the order summaries list them: its sign and name, what it is, why and what to do.
CLASSES = {
    "auth": ("🔐 Authentication", "Authentication issue", "The source or proxy asks for valid credentials.", "Capture a logged-in session; for HTTP 407 check the proxy too."),
    "input_source": ("❌ Input/Source", "Input/source issue", "The source could not be resolved or is gone.", "Check the address, DOI or reference and retry with current data."),
    "network": ("🌐 Network", "Network issue", "Connection or transport broke requests off.", "Check the connection, VPN and proxy, then retry."),
    "other": ("⚠️ Other", "Unhandled issue", "The failure fits no known class.", "Look at the logs and rerun; open items stay queued."),
}
#: What to do, by the stored type of an error, as it is appended to messages.
SUGGESTIONS = {"network": "Check the network or VPN, then retry with more attempts if needed.", "auth": "Capture a logged-in session (or set proxy credentials for HTTP 407) and retry.", "not_found": "Check that the address, DOI or reference is still valid, then rerun.", "parse_error": "Check the form of the address, DOI or reference and rerun."}
TLS_WORDS = ["certificate", "tls", "ssl", "handshake"]
BASE_DELAY_MS, MOST_DELAY_MS, DEFAULT_ATTEMPTS, MOST_RETRY_AFTER_S = 1000, 32000, 3, 3600


def _ladder(message: Column, part: int) -> Column:
    rules = [F.when(message.rlike(rule[2]), F.lit(rule[part])) for rule in MESSAGE_RULES]
    return F.coalesce(*rules, F.lit(OTHER[part]))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def failure_class(message: Column) -> Column:
    return _ladder(message, 0)


def failure_what(message: Column) -> Column:
    return _ladder(message, 1)


def failure_why(what: Column) -> Column:
    return _looked_up(what, {k: v[0] for k, v in REMEDIES.items()})


def failure_fix(what: Column) -> Column:
    return _looked_up(what, {k: v[1] for k, v in REMEDIES.items()})


def described_class(error_type: Column, message: Column) -> Column:
    """Class by the stored type, else by the message, else ``other``."""
    typed = F.coalesce(*[F.when(error_type == k, F.lit(v[0])) for k, v in TYPE_RULES.items()], F.lit(None).cast("string"))
    return F.coalesce(typed, F.when(message.isNotNull(), failure_class(message)), F.lit(OTHER[0]))


def described_what(error_type: Column, http_status: Column, message: Column) -> Column:
    proxy = F.when((error_type == "auth") & (http_status == 407), F.lit(MESSAGE_RULES[0][1]))
    typed = F.coalesce(proxy, *[F.when(error_type == k, F.lit(v[1])) for k, v in TYPE_RULES.items()])
    return F.coalesce(typed, F.when(message.isNotNull(), failure_what(message)), F.lit(OTHER[1]))


def suggestion(error_type: Column, http_status: Column, message: Column) -> Column:
    """What to do: by the stored type, else what the message itself suggests, else that of a network failure."""
    typed = F.when(error_type.isin(*TYPE_RULES), failure_fix(described_what(error_type, http_status, F.lit(None).cast("string"))))
    own = F.nullif(F.trim(F.when(F.contains(message, F.lit("Suggestion:")), F.regexp_replace(message, r"^[\s\S]*?Suggestion:", ""))), F.lit(""))
    return F.coalesce(typed, own, F.lit(REMEDIES["Network request failed"][1]))


def auth_domain(message: Column) -> Column:
    """Domain of an authentication failure message; null for others."""
    return F.nullif(F.regexp_extract(message, r"^\[AUTH\] authentication required for (.*?) \(HTTP", 1), F.lit(""))


def status_class(status: Column) -> Column:
    """permanent, transient, needs_auth or rate_limited."""
    return F.when(status.isin(401, 403, 407), "needs_auth").when(status == 429, "rate_limited").when((status == 408) | status.between(500, 599), "transient").otherwise("permanent")


def is_tls_failure(message: Column) -> Column:
    """The message of a network error speaks of certificates or the handshake."""
    return F.coalesce(F.lower(message).rlike("|".join(TLS_WORDS)), F.lit(False))


def error_class(kind: Column, status: Column, message: Column) -> Column:
    """The class of an error by its kind: auth, http_status, timeout, network, io, invalid_url or integrity.

    Network errors pass, unless they are of TLS; what is wrong here (io, invalid_url, integrity) stays wrong.
    """
    return F.when(kind == "auth", "needs_auth").when(kind == "http_status", status_class(status)).when(kind == "timeout", "transient").when(kind == "network", F.when(is_tls_failure(message), "permanent").otherwise("transient")).otherwise("permanent")


def status_error_type(status: Column) -> Column:
    return F.when(status.isin(401, 403, 407), "auth").when(status == 404, "not_found").otherwise("network")


def error_type(kind: Column, status: Column) -> Column:
    """The stored type of an error by its kind (as for ``error_class``)."""
    return F.when(kind == "auth", "auth").when(kind == "http_status", status_error_type(status)).when(kind == "invalid_url", "parse_error").otherwise("network")


def actionable(message: Column, stored_type: Column) -> Column:
    """A message with what to do appended, unless it says so itself."""
    return F.when(F.contains(message, F.lit("Suggestion:")), message).otherwise(F.concat(message, F.lit("\n  Suggestion: "), _looked_up(stored_type, SUGGESTIONS)))


def retry_delay_ms(attempt: Column) -> Column:
    """Delay after the n-th attempt, without jitter."""
    return F.least(F.lit(BASE_DELAY_MS) * F.pow(F.lit(2), attempt - 1), F.lit(float(MOST_DELAY_MS))).cast("bigint")


def retry_after_s(header: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date; capped at an hour, null when negative or unreadable, 0 when past."""
    number = F.trim(header).try_cast("bigint")
    moment = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.unix_timestamp(moment) - F.unix_timestamp(now), F.lit(0))
    return F.when(number.isNotNull(), F.when(number >= 0, F.least(number, F.lit(MOST_RETRY_AFTER_S)))).when(moment.isNotNull(), F.least(wait, F.lit(MOST_RETRY_AFTER_S)))
