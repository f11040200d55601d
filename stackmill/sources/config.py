"""Settings of a file of ``key = value`` lines, and how they and what a caller gives combine."""

from __future__ import annotations

# The keys with their kinds, and what respectful runs set.
KEYS = {"output_dir": str, "concurrency": int, "rate_limit": int, "respectful": bool, "check_robots": bool, "verbosity": str, "detect_topics": bool, "topics_file": str, "sidecar": bool, "download_connect_timeout_secs": int, "download_read_timeout_secs": int, "resolver_connect_timeout_secs": int, "resolver_read_timeout_secs": int, "db_max_connections": int, "db_busy_timeout_ms": int, "tos_acknowledged": bool}
RANGES = {"concurrency": (1, 100)}
RESPECTFUL = {"concurrency": 2, "rate_limit": 3000, "max_retries": 1, "rate_limit_jitter": 1000, "check_robots": True}

Settings = dict[str, str | int | bool]


def _without_comment(line: str) -> str:
    quoted = ""
    for i, c in enumerate(line):
        if quoted:
            quoted = "" if c == quoted and line[i - 1] != "\\" else quoted
        elif c in "\"'":
            quoted = c
        elif c == "#":
            return line[:i]
    return line


def _value(key: str, text: str) -> str | int | bool:
    kind = KEYS[key]
    if kind is bool:
        if text not in ("true", "false"):
            raise ValueError("expected true or false")
        return text == "true"
    if kind is int:
        if not text.isascii() or not text.isdigit():
            raise ValueError("expected a whole number")
        number, (low, high) = int(text), RANGES.get(key, (0, 2**64 - 1))
        if not low <= number <= high:
            raise ValueError(f"expected a number from {low} to {high}")
        return number
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if not text or text[0] in "\"'":
        raise ValueError("expected a quoted text")
    return text


def parsed(text: str) -> Settings:
    """The settings of a file. A line that is no setting, an unknown key or a value of the wrong kind is an error."""
    out: Settings = {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = _without_comment(raw).strip()
        if not line:
            continue
        key, equals, value = line.partition("=")
        key = key.strip()
        if not equals:
            raise ValueError(f"line {number}: expected key = value")
        if key not in KEYS:
            raise ValueError(f"line {number}: unknown key {key!r}")
        try:
            out[key] = _value(key, value.strip())
        except ValueError as wrong:
            raise ValueError(f"line {number}: {key}: {wrong}") from None
    return out


def effective(file: Settings, given: Settings) -> Settings:
    """What holds: what the caller gives over the file, and respectful runs over both."""
    out = {**file, **given}
    return {**out, **RESPECTFUL} if out.get("respectful") else out
