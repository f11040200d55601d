"""Items in running text: the parts whose grammar is not regular. Pure Python, run on Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from urllib.parse import unquote

import regex

# Patterns of addresses, DOIs, bare identifiers and references.
URL_CANDIDATE = re.compile(r"https?://[^\s<>\"'\]]+")
DOI_BODY = r"10\.\d{4,9}(?:\.\d+)*/[^\s<>\"'\]]+"
DOI_AT_URL = re.compile(rf"https?://(?:dx\.)?doi\.org/({DOI_BODY})")
DOI_LABELLED = re.compile(rf"doi:\s*({DOI_BODY})", re.I)
DOI_BARE = re.compile(rf"(?<![A-Za-z0-9.]){DOI_BODY}")
DOI_WHOLE = re.compile(r"10\.\d{4,}(?:\.[^/]*)?/.+", re.S)
EXTENSION = re.compile(r"\.[A-Za-z0-9]{1,5}$")
ARXIV = r"(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?"
KNOWN_LINE = re.compile(rf"^(?:(PMC\d{{4,}})|(?:arXiv:\s*)?({ARXIV})|PMID[:\s]\s*(\d{{1,9}}))$", re.I)
YEAR_BARE = re.compile(r"\b(?:18|19|20)\d\d\b")
YEAR_IN_PARENTHESES = re.compile(r"\((\d{4})\)")
AUTHOR = regex.compile(r"\p{Lu}[\p{L}'`\-]+,\s*(?:\p{Lu}\.|\p{Lu}\p{L}+)")
ET_AL = regex.compile(r"\p{Lu}[\p{L}'`\-]+\s+et al\.")
YEAR_START = re.compile(r"\(?\d{4}\)?\b")
NUMBERED = re.compile(r"\s*(?:\[\d{1,3}\]|\d{1,3}[.)])\s*(?=.)")
BIBTEX_HEAD = re.compile(r"@[A-Za-z]*\s*\{")
BIBTEX_LINE = re.compile(r"@[A-Za-z]*\{")
CITATION_WORDS = ["journal", "vol.", "pp.", "et al."]
HEADINGS = ["references", "bibliography", "works cited", "literature", "sources", "further reading", "cited works", "reference list"]
BIBTEX_TYPES, BIBTEX_BLOCKS = ["article", "book", "inproceedings"], ["comment", "preamble", "string"]
DOI_HOSTS = ["doi.org", "dx.doi.org"]
MOST_URL_BYTES, PREVIEW_CHARS, FIRST_YEAR, LAST_YEAR = 2000, 50, 1800, 2100
CLOSERS = {")": "(", "]": "[", "}": "{"}

_MARKS = re.compile(r"\\.|[\"{},]", re.S)
_LINE_AT = re.compile(r"(?<=[\r\n])@")
_SPACE = re.compile(r"\s")
_SIGNS = re.compile(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\s]*")


@dataclass
class Parsed:
    """Items as (phase, kind, raw, value), in the order of the contract, and what was set apart."""

    items: list[tuple[int, str, str, str]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


@dataclass
class BibtexEntry:
    raw: str
    entry_type: str
    key: str
    fields: dict[str, str]

    @property
    def doi(self) -> str | None:
        return next((doi for _, doi in dois(self.fields.get("doi", ""))), None)

    @property
    def authors(self) -> str:
        return ", ".join(a.strip() for a in re.split(r"\s+and\s+", self.fields.get("author", ""), flags=re.I) if a.strip())

    @property
    def year(self) -> str | None:
        found = YEAR_BARE.search(self.fields.get("year", ""))
        return found.group() if found else None


def trim_closers(text: str, closers: str, start: int = 0) -> str:
    """Closing brackets at the end that have no opening one, counted from ``start``."""
    while text and text[-1] in closers and text.count(text[-1], start) > text.count(CLOSERS[text[-1]], start):
        text = text[:-1]
    return text


def trim_url(text: str) -> str:
    """A URL candidate without brackets and sentence punctuation that belong to the text around it."""
    while True:
        shorter = trim_closers(text, ")]")
        if shorter and shorter[-1] in ".,;:!?" and not (shorter[-1] == "." and EXTENSION.search(shorter)):
            shorter = shorter[:-1]
        if shorter == text:
            return text
        text = shorter


def normal_url(text: str) -> str | None:
    """The address with lower-case scheme and host, no default port and a path; null when not valid."""
    m = re.match(r"^(https?)://(?:([^/?#@]*)@)?([^/?#:]+)(?::(\d*))?([^?#]*)(.*)$", text, re.I | re.S)
    if not m or len(text.encode()) > MOST_URL_BYTES:
        return None
    scheme, user, host, port, path, rest = m.groups()
    scheme = scheme.lower()
    keep = port and port != {"http": "80", "https": "443"}[scheme]
    return f"{scheme}://{user + '@' if user else ''}{host.lower()}{':' + port if keep else ''}{path or '/'}{rest}"


def urls(text: str) -> list[tuple[int, str, str | None]]:
    """(place, raw, address or null) of every URL candidate."""
    return [(m.start(), m.group(), normal_url(trim_url(m.group()).replace("\\", ""))) for m in URL_CANDIDATE.finditer(text)]


def refused_url(raw: str) -> str:
    """How a candidate that is no address is reported: as it was tried, long ones by their beginning."""
    tried = trim_url(raw).replace("\\", "")
    return tried[:PREVIEW_CHARS] if len(tried.encode()) > MOST_URL_BYTES else tried


def at_doi_host(address: str) -> bool:
    return address.split("/", 3)[2].rpartition("@")[2].partition(":")[0] in DOI_HOSTS


def _decoded(text: str) -> str:
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return text


def dois(text: str) -> list[tuple[str, str]]:
    """(raw, doi): those of addresses first, then labelled ones, then bare ones; no text is used twice."""
    return [(raw, body) for raw, body in _doi_candidates(text) if DOI_WHOLE.fullmatch(body)]


def _doi_candidates(text: str) -> list[tuple[str, str]]:
    if "10." not in text:
        return []
    out: list[tuple[str, str]] = []
    taken: list[tuple[int, int]] = []
    spaces: list[int] | None = None
    for pattern in (DOI_AT_URL, DOI_LABELLED, DOI_BARE):
        begins, fresh = [a for a, _ in taken], []
        for m in pattern.finditer(text):
            # Earlier passes' spans are sorted and apart: only the last that begins before the end can overlap.
            at = bisect_left(begins, m.end()) - 1
            if at >= 0 and taken[at][1] > m.start():
                continue
            if pattern is DOI_BARE:
                spaces = [s.start() for s in _SPACE.finditer(text)] if spaces is None else spaces
                before = bisect_right(spaces, m.start()) - 1
                if "://" in text[spaces[before] + 1 if before >= 0 else 0 : m.start()]:
                    continue
            fresh.append(m.span())
            body = trim_url(_decoded(m.group(1) if m.lastindex else m.group()).strip())
            for closer in ")}":
                body = trim_closers(body, closer, body.find("/") + 1)
            out.append((m.group(), body))
        taken = sorted(taken + fresh)
    return out


def known_ids(text: str) -> list[tuple[str, str]]:
    """(line, identifier) of the lines that are one PMC, arXiv or PubMed identifier; repeated ones once."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        if m := KNOWN_LINE.match(line):
            found = m.group(1).upper() if m.group(1) else m.group(2) or f"PMID:{m.group(3)}"
            out.setdefault(found, line)
    return [(line, found) for found, line in out.items()]


def _closing(text: str, at: int) -> int:
    """Place after the brace that closes the one at ``at``; -1 when none does. Quotation marks and escapes count."""
    depth, quoted = 0, False
    for m in _MARKS.finditer(text, at):
        sign = m.group()
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in "{}":
            depth += 1 if sign == "{" else -1
            if depth == 0:
                return m.end()
    return -1


def bibtex_spans(text: str) -> list[tuple[int, int]]:
    """Where something begins like a BibTeX entry, and its closing brace ends it.

    One that is never closed reaches to the next ``@`` at the start of a line, so that it does not
    take the entries after it along.
    """
    out, at = [], 0
    while m := BIBTEX_HEAD.search(text, at):
        end = _closing(text, m.end() - 1)
        if end < 0:
            after = _LINE_AT.search(text, m.start() + 1)
            end = after.start() if after else len(text)
        out.append((m.start(), m.start() + len(text[m.start() : end].strip())))
        at = end
    return out


def _fields(text: str) -> dict[str, str] | str:
    """Names and values of an entry's fields, the first value of a name; or what is wrong with them."""
    depth, quoted, begin, parts = 0, False, 0, []
    for m in _MARKS.finditer(text):
        sign = m.group()
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in "{}":
            depth += 1 if sign == "{" else -1
            if depth < 0:
                return "a closing brace without an opening one"
        elif not quoted and sign == "," and depth == 0:
            parts.append(text[begin : m.start()])
            begin = m.end()
    if quoted or depth:
        return "a quoted value is not closed" if quoted else "braces in the values are not balanced"
    out: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in [*parts, text[begin:]])):
        name, equals, value = part.partition("=")
        name, value = name.strip().lower(), value.strip().rstrip(",").strip()
        if not equals or not name or not value:
            return f"no name, equals sign or value in `{part}`"
        if len(value) >= 2 and value[0] + value[-1] == "{}":
            value = value[1:-1].strip()
        elif len(value) >= 2 and value[0] == value[-1] == '"':
            value = value[1:-1].replace('\\"', '"').strip()
        out.setdefault(name, value)
    return out


def bibtex_entry(segment: str) -> BibtexEntry | str | None:
    """An entry; or, as text, why it is skipped; or null for blocks that are no entries."""
    kind, _, body = segment[1:].partition("{")
    kind = kind.strip().lower()
    shown = segment if len(segment) <= 80 else segment[:80] + "..."
    why = lambda reason, fix: f"What: malformed BibTeX entry `{shown}`. Why: {reason}. Fix: {fix}."
    if kind in BIBTEX_BLOCKS:
        return None
    if kind not in BIBTEX_TYPES:
        return f"What: unsupported BibTeX entry type `@{kind}`. Why: only {', '.join('@' + t for t in BIBTEX_TYPES)} are read. Fix: export one of these types or give the DOI."
    if not segment.endswith("}"):
        return why("braces are not balanced", "close every brace")
    key, comma, rest = body[:-1].partition(",")
    if not comma or not key.strip():
        return why("the citation key or the fields are missing", f"write `@{kind}{{key, field = value}}`")
    fields = _fields(rest)
    if isinstance(fields, str):
        return why(fields, "write `field = {value}` with commas between fields")
    return BibtexEntry(segment, kind, key.strip(), fields)


def reference_value(authors: str | None, year: str | None, title: str | None) -> str | None:
    """``authors (year) title.`` of what there is."""
    parts = [authors or "", f"({year})" if year else "", (title if title.endswith(".") else title + ".") if title else ""]
    return " ".join(p for p in parts if p) or None


def bibtex_items(entry: BibtexEntry) -> list[tuple[str, str, str]]:
    """(kind, raw, value): the entry itself, its DOI, and it as a reference."""
    out = [("bibtex", entry.raw, entry.key)]
    if doi := entry.doi:
        out.append(("doi", entry.raw, doi))
    if said := reference_value(entry.authors, entry.year, entry.fields.get("title")):
        out.append(("reference", entry.raw, said))
    return out


def bibliography(text: str) -> list[str]:
    """Entries of running text: blocks at blank lines, entries inside blocks, those alone that look like references.

    An entry begins with a number, or, after a line that ends in a full stop, with an author or a year.
    """
    out: list[str] = []
    for block in re.split(r"\n(?:[^\S\n]*\n)+", "\n".join(text.splitlines())):
        entries: list[list[str]] = []
        for line in map(str.strip, block.splitlines()):
            if line.rstrip(":").strip().lower() in HEADINGS or _SIGNS.fullmatch(line):
                continue
            number = NUMBERED.match(line)
            rest = line[number.end() :].strip() if number else line
            if not rest:
                continue
            if number or not entries or (entries[-1][-1].endswith(".") and (AUTHOR.match(rest) or YEAR_START.match(rest))):
                entries.append([rest])
            else:
                entries[-1].append(rest)
        out += [" ".join(e) for e in entries]
    return [e for e in out if is_reference_like(e)]


def is_reference_like(entry: str) -> bool:
    """Long enough, with a year and another sign of a reference, or with several of the others."""
    if len(entry.encode()) < 20:
        return False
    low, commas, stops = entry.lower(), entry.count(","), entry.count(".")
    word = any(w in low for w in CITATION_WORDS)
    listed = commas >= 2 or stops >= 2 or bool(AUTHOR.match(entry))
    return commas >= 3 or (listed and (word or bool(YEAR_BARE.search(entry)))) or (word and bool(YEAR_BARE.search(entry)))


def is_acceptable(entry: str, last_year: int = LAST_YEAR) -> bool:
    """Authors or a year are found in it; a title alone is not enough."""
    year = next((m for pattern in (YEAR_IN_PARENTHESES, YEAR_BARE) for m in pattern.finditer(entry) if FIRST_YEAR <= int(m.group().strip("()")) <= last_year), None)
    return year is not None or bool(ET_AL.search(entry) or AUTHOR.search(entry))


def _residual(text: str, ids: set[str]) -> str:
    """What is left for bibliographies and BibTeX: lines without their DOIs and addresses, BibTeX lines whole."""
    out, depth = [], 0
    for line in map(str.strip, text.splitlines()):
        if depth > 0 or BIBTEX_LINE.match(line):
            quoted = False
            for m in _MARKS.finditer(line):
                if m.group() == '"':
                    quoted = not quoted
                elif not quoted and m.group() in "{}":
                    depth += 1 if m.group() == "{" else -1
            depth = max(depth, 0)
        elif line not in ids:
            for raw in [*(raw for raw, _ in dois(line)), *(raw for _, raw, address in urls(line) if address and not at_doi_host(address))]:
                line = line.replace(raw, " ", 1)
        out.append("" if line in ids else line.strip())
    return "\n".join(out)


def parse(text: str) -> Parsed:
    """All items of a text in the order of the contract, and what was set apart.

    DOIs, each once; addresses (those of doi.org only as DOIs), as often as they occur; bare
    identifiers; then from what is left the references of the bibliography and, entry by entry, the
    BibTeX entries with their DOI, where it is new, and reference. Reported as skipped are refused
    DOIs and addresses, references without authors or year, and BibTeX entries with their fault.
    """
    found = Parsed()
    seen: set[str] = set()
    for raw, doi in _doi_candidates(text):
        if not DOI_WHOLE.fullmatch(doi):
            found.skipped.append(doi)
        elif doi not in seen:
            seen.add(doi)
            found.items.append((1, "doi", raw, doi))
    for _, raw, address in urls(text):
        if address is None:
            found.skipped.append(refused_url(raw))
        elif not at_doi_host(address):
            found.items.append((3, "url", raw, address))
    ids = known_ids(text)
    found.items += [(4, "unknown", raw, value) for raw, value in ids]
    left = _residual(text, {raw for raw, _ in ids})
    spans = bibtex_spans(left)
    edges = [0, *(x for span in spans for x in span), len(left)]
    for entry in bibliography(" ".join(left[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))):
        if is_acceptable(entry):
            found.items.append((5, "reference", entry, entry))
        else:
            found.skipped.append(f"unparseable reference-like entry: {entry}")
    for a, b in spans:
        entry = bibtex_entry(left[a:b])
        if isinstance(entry, str):
            found.skipped.append(entry)
        elif entry is not None:
            for kind, raw, value in bibtex_items(entry):
                if kind != "doi" or value not in seen:
                    seen |= {value} if kind == "doi" else set()
                    found.items.append((6, kind, raw, value))
    return found


def items(text: str) -> list[tuple[int, str, str, str]]:
    """The items of ``parse``."""
    return parse(text).items


def looks_like_reference(line: str) -> bool:
    """Long enough, and with a year, three commas or a word of citations."""
    return len(line.encode()) > 20 and bool(YEAR_BARE.search(line) or line.count(",") >= 3 or any(w in line.lower() for w in CITATION_WORDS))
