"""Several values packed in one field: one row per value with its place (problem 6).

The dialect of a field (which delimiters it uses, and whether quotation marks and braces protect)
is chosen by minimum description length. Every candidate parse is charged for its delimiters and
for each value; the code length of a value comes from the frequency of its form in the whole corpus
(``I W``, ``W, W``, ``W W F W``, ...: initials, words, function words, commas). No delimiter is taken
for granted: semicolon, bar, tab, line end, slash, ``and``, ``&`` and comma are all scored.

Only the skeleton of a field decides: its delimiters and, for each word, what kind of word it is.
Skeletons are counted once over the corpus, with map-side combining; the form counts are estimated
in two rounds over the distinct skeletons (first from the values that all of the rarer delimiters
cut, then from the parses chosen with those code lengths), and a task parses each skeleton once.
No row is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackmill.session import cut

# Signs for left-out names, stand-ins for a missing value, name suffixes, words that bind names of organisations.
LEFT_OUT = r"(?:\bet\.?\s+al\b\.?|\b(?:and|&)\s+others\b|&\s+others\b|\bothers\b|\betc\b\.?|\b(?-i:u\.\s?a\.)|\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…)"
STAND_INS = ["", "-", "--", "?", "n/a", "na", "n.n.", "nn", "none", "null", "nil", "tbd", "unknown", "unknown author", "unknown authors", "anonymous", "anon", "anon.", "no author", "[authors missing]", "[author missing]", "[no authors listed]", "authors missing"]
SUFFIX = r"(?:jr|sr|ii|iii|iv)\.?"
FUNCTION_WORDS = ["for", "of", "on", "the", "in", "at", "de", "du", "la", "für"]
CONJUNCTIONS = ["and", "&", "und", "et"]

_SUFFIX_HINT = re.compile(r"[JjSs][Rr]|II|ii|IV|iv")
_PROTECTED = re.compile(r'"[^"]*"|\{[^{}]*\}|“[^”]*”')
_SUFFIX_COMMA = re.compile(rf",(?=\s*{SUFFIX}(?:\s*(?:[;,|/&\t\n]|$)|\s+and\b))", re.I)
_COMMA = re.compile(r",")
#: Delimiters that cut wherever they stand, each with what every match holds in lower case.
DELIMITERS = [(";", re.compile(r";+")), ("|", re.compile(r"\|+")), ("\t", re.compile(r"\t+")), ("\n", re.compile(r"[\r\n]+")), ("\r", re.compile(r"\r+")), ("/", re.compile(r"/")), ("and", re.compile(r"\s*,?\s+and\s+|^\s*and\s+", re.I)), ("&", re.compile(r"\s*,?\s*&\s*"))]
RARE_MARKS = ";|\t\r\n/"
_RARE = re.compile(r"[;|\t\r\n]+|/")
_LEFT_OUT_END = re.compile(rf"[\s,;&/|]*{LEFT_OUT}[\s,;&/|.]*$", re.I)
_LEFT_OUT_HINT = re.compile(r"\bal\b|others|etc|\.\.\.|…|u\.", re.I)
_LEFT_OUT_ALL = re.compile(rf"^[\s\[\](),;.]*{LEFT_OUT}[\s\[\](),;.]*$", re.I)
_INITIALS = re.compile(r"^(?:[^\W\d_]\.-?)+[^\W\d_]?\.?$|^[^\W\d_]$")
_SUFFIX_WORD = re.compile(rf"^{SUFFIX}$", re.I)
_ONLY_PUNCTUATION = re.compile(r"^[\W_]*$")
_PART = re.compile(r"""[^\s,;|/&"{}“”()\[\]]+|.""", re.S)
_PART_DOTS = re.compile(r"""\.\.\.|(?:(?!\.\.\.)[^\s,;|/&"{}“”()\[\]…])+|.""", re.S)
_LEFT_OUT_WORD = re.compile(r"\b(?:et|al|and|others|etc)\b|^(?:u\.|a\.|u\.a\.)$", re.I)

#: Forms rarer than this share of all values are coded letter by letter; so at most 1/MIN_SHARE forms are kept.
MIN_SHARE = 1e-5
#: Weight of a field without a rarer delimiter in the first count: it may hold one value or be cut by commas.
SINGLE_WEIGHT = 0.001
ESCAPE_BITS, ESCAPE_BITS_PER_TOKEN, VALUE_BITS, DELIMITER_BITS = 14.0, 3.0, 1.0, 2.0
#: Words, and stretches of at most SHORT characters, that a Python worker remembers.
MEMORY, SHORT = 20_000, 60

Codes = dict[str, float]
Span = tuple[int, int]
Value = tuple[int, int, str]


def _sign(word: str, long: bool) -> str:
    """The kind of a word; in a long value short lower-case words are function words, also with a slip of the pen."""
    if len(word) > 7 and word[-1] != ".":
        return "W"
    if long and len(word) <= 4 and word.islower() and word not in CONJUNCTIONS:
        return "F"
    if _INITIALS.match(word):
        return "I"
    if _SUFFIX_WORD.match(word):
        return "J"
    if word.lower() in FUNCTION_WORDS:
        return "F"
    if word.lower() in CONJUNCTIONS:
        return "N"
    if word.isupper() and 3 <= len(word) <= 7:
        return "A"
    return "B" if word.endswith(".") else "W"


def form_of(value: str) -> str:
    """The form of a value: one sign per word and delimiter, commas kept."""
    value = value.replace("\x00", ",")
    long = value.count(" ") >= 3
    if _RARE.search(value):
        value = _RARE.sub(" ; ", value)
    signs = []
    for part in value.split(","):
        words = [w for w in (word.strip("\"{}“”()[]") for word in part.split()) if w]
        signs.append(" ".join(w if w == ";" else _sign(w, long) for w in words))
    return ",".join(signs)


@lru_cache(maxsize=10 * MEMORY)
def _stand_in(part: str) -> str:
    """What stands for a part of a field in its skeleton: itself for delimiters and telling words, else a word of its kind."""
    low = part.lower()
    if _ONLY_PUNCTUATION.match(part) or low in _TELLING or _LEFT_OUT_WORD.search(part):
        return "a." if part == "A." else part
    if part.islower() and len(part) <= 4:
        return {(True, True): "x", (False, True): "x.", (True, False): "xx", (False, False): "xx."}[part[-1] != ".", bool(_INITIALS.match(part))]
    return {"I": "I.", "A": "AAA", "B": "Xxx.", "W": "Xxxxxxxx" if len(part) > 7 else "Xxx"}.get(_sign(part, False), part)


_TELLING = {w for phrase in [*STAND_INS, *FUNCTION_WORDS, *CONJUNCTIONS] for w in re.split(r"[\s/\[\]]+", phrase)} | {s + dot for s in ("jr", "sr", "ii", "iii", "iv") for dot in ("", ".")}


def parts_of(text: str) -> list[str]:
    """Words, and every other character by itself; joined they are the text."""
    return (_PART_DOTS if "..." in text or "…" in text else _PART).findall(text)


def skeleton(text: str) -> str:
    """The text with every word replaced by one of its kind: fields of one skeleton are parsed alike."""
    return "".join(map(_stand_in, parts_of(text)))


def _pieces(text: str, spans: list[Span], pattern: re.Pattern[str], shield: list[Span]) -> list[Span]:
    """The spans cut at every match that no protected part covers."""
    out = []
    for begin, end in spans:
        at = begin
        for m in pattern.finditer(text, begin, end):
            if m.end() == m.start() or any(a < m.end() and m.start() < b for a, b in shield):
                continue
            out.append((at, m.start()))
            at = m.end()
        out.append((at, end))
    return out


def _without_left_out(text: str) -> str:
    """Text without a sign for left-out names at its end."""
    return _LEFT_OUT_END.sub("", text) if _LEFT_OUT_HINT.search(text) else text


def _clean(text: str) -> str:
    """A value without the spaces, quotation marks, braces and left-out signs around it."""
    value = _without_left_out(text.strip().strip("\"{}“”").strip())
    return value.strip().strip("\"{}“”").strip().rstrip(",;").strip()


def _is_value(text: str) -> bool:
    return not (_ONLY_PUNCTUATION.match(text) or _LEFT_OUT_ALL.match(text) or text.lower() in STAND_INS)


class Parser:
    """Cheapest parses under given code lengths.

    Costs and values of short stretches of skeletons are remembered, so a field costs little more
    than cutting it into its words.
    """

    def __init__(self, codes: Codes) -> None:
        self.codes = codes
        self.longest = max((form.count(" ") + form.count(",") for form in codes), default=0) + 2
        self.marked = any(mark in form for form in codes for mark in RARE_MARKS)
        self._known: dict[tuple[str, int], tuple[float, tuple[Value, ...]]] = {}
        self._placed: dict[str, list[Span] | None] = {}

    def _cost(self, form: str) -> float:
        known = self.codes.get(form)
        return VALUE_BITS + (known if known is not None else ESCAPE_BITS + ESCAPE_BITS_PER_TOKEN * (1 + form.count(" ") + form.count(",")))

    def _one(self, stretch: str) -> tuple[float, tuple[Value, ...]]:
        """Cost and values of a stretch taken as one value; it may hold none."""
        value = _clean(stretch)
        if not _is_value(value):
            return 0.0, ()
        form, at = form_of(value), stretch.find(value)
        return self._cost(form), ((at, at + len(value), form),)

    def _several(self, stretch: str, quoting: bool) -> tuple[float, tuple[Value, ...]]:
        """The same, cut at commas into values of one or two parts, whatever codes shortest."""
        shield = [m.span() for m in _PROTECTED.finditer(stretch)] if quoting and _may_protect(stretch) else []
        atoms = _pieces(stretch, [(0, len(stretch))], _COMMA, shield)
        best: list[tuple[float, int]] = [(0.0, 0)]
        for i, (_, end) in enumerate(atoms):
            options = [(best[i][0] + self.read(stretch[atoms[i][0] : end], 0)[0], 1)]
            if i:
                options.append((best[i - 1][0] + self.read(stretch[atoms[i - 1][0] : end], 0)[0], 2))
            best.append(min(options))
        values, i = [], len(atoms)
        while i:
            width = best[i][1]
            begin = atoms[i - width][0]
            values += [(begin + a, begin + b, form) for a, b, form in reversed(self.read(stretch[begin : atoms[i - 1][1]], 0)[1])]
            i -= width
        return best[-1][0], tuple(reversed(values))

    def read(self, stretch: str, commas: int) -> tuple[float, tuple[Value, ...]]:
        """Cost and values of a stretch: as one value (0), or cut at commas with (1) or without (2) regard to quotation marks."""
        key = (stretch, commas if "," in stretch else 0)
        found = self._known.get(key)
        if found is None:
            found = self._several(stretch, commas == 1) if key[1] else self._one(stretch)
            if len(stretch) <= SHORT:
                if len(self._known) >= MEMORY:
                    self._known.clear()
                self._known[key] = found
        return found

    def _too_long(self, stretch: str) -> float | None:
        """Cost of a stretch of more words than any known form, taken as one value."""
        tokens = stretch.count(" ") + stretch.count(",")
        return VALUE_BITS + ESCAPE_BITS + ESCAPE_BITS_PER_TOKEN * (1 + tokens) if tokens > self.longest and len(stretch) > SHORT else None

    def parse(self, text: str) -> list[Value]:
        """(begin, end, form) of the values of ``text`` in its cheapest dialect; fewer delimiters win a tie.

        All subsets of the delimiters that occur are compared, with and without regard to quotation
        marks, beginning with all of them; a subset whose uncut delimiters alone cost more than the
        best is passed over.
        """
        if text.strip().lower() in STAND_INS:
            return []
        text, protected = _prepared(text)
        low = text.lower()
        present = [(p, text.count(sign) if sign in RARE_MARKS else 0) for sign, p in DELIMITERS if sign in low and p.search(text)]
        best: tuple[float, int] | None = None
        chosen: tuple[list[Span], int] = ([], 0)
        for quoting in (True, False) if protected else (True,):
            for used in product((True, False), repeat=len(present)):
                delimiters = sum(used) + (not quoting) * 2
                if best is not None and not self.marked:
                    # Delimiters left uncut are words of values that no known form holds.
                    left = sum(n for (_, n), on in zip(present, used, strict=True) if not on)
                    if left and delimiters * DELIMITER_BITS + VALUE_BITS + ESCAPE_BITS + ESCAPE_BITS_PER_TOKEN * left > best[0]:
                        continue
                spans = [(0, len(text))]
                for (pattern, _), on in zip(present, used, strict=True):
                    if on:
                        spans = _pieces(text, spans, pattern, protected if quoting else [])
                for commas in (0, 1 if quoting else 2) if "," in text else (0,):
                    cost = (delimiters + (commas > 0)) * DELIMITER_BITS
                    held = 0
                    for a, b in spans:
                        long = self._too_long(text[a:b]) if not commas else None
                        if long is None:
                            part, values = self.read(text[a:b], commas)
                            cost += part
                            held += len(values)
                        else:
                            cost += long
                            held += 1
                    if held and (best is None or (cost, delimiters + (commas > 0)) < best):
                        best, chosen = (cost, delimiters + (commas > 0)), (spans, commas)
        return [(a + x, a + y, form) for a, b in chosen[0] for x, y, form in self.read(text[a:b], chosen[1])[1]]

    def _places(self, bones: str) -> list[Span] | None:
        """Where the values of a skeleton lie, in parts; None when an end lies within a part."""
        if bones not in self._placed:
            if len(self._placed) >= MEMORY:
                self._placed.clear()
            self._placed[bones] = self._place(bones)
        return self._placed[bones]

    def _place(self, bones: str) -> list[Span] | None:
        found = self.parse(bones)
        if not found:
            return []
        ends, at = {0: 0}, 0
        for i, part in enumerate(parts_of(bones), 1):
            at += len(part)
            ends[at] = i
        if any(a not in ends or b not in ends for a, b, _ in found):
            return None
        return [(ends[a], ends[b]) for a, b, _ in found]

    def values(self, text: str) -> list[str]:
        """The values of a field in its cheapest dialect."""
        parts = parts_of(text)
        places = self._places("".join(map(_stand_in, parts)))
        if places is None:
            return [text[a:b] for a, b, _ in self.parse(text)]
        return ["".join(parts[a:b]) for a, b in places]

    def count(self, text: str) -> int:
        """How many values a field holds."""
        places = self._places(skeleton(text))
        return len(self.parse(text) if places is None else places)


def cheapest(text: str, codes: Codes) -> list[str]:
    """The values of ``text`` in its cheapest dialect."""
    return Parser(codes).values(text)


def _prepared(text: str) -> tuple[str, list[Span]]:
    """Text with suffix commas hidden and no sign for left-out names at its end, and its protected parts."""
    if "," in text and _SUFFIX_HINT.search(text):
        text = _SUFFIX_COMMA.sub("\x00", text)
    text = _without_left_out(text)
    return text, [m.span() for m in _PROTECTED.finditer(text)] if _may_protect(text) else []


def _may_protect(text: str) -> bool:
    return '"' in text or "{" in text or "“" in text


def _count_skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = Counter(map(skeleton, batch["text"]))
        yield pd.DataFrame({"bones": list(counts), "n": list(counts.values())}, columns=["bones", "n"])


def _count_forms(made: Callable[[], Callable[[str], list[tuple[str, float]]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Weighted counts of the forms found in each skeleton; ``made`` makes the finder once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = made()
        for batch in batches:
            counts: Counter[str] = Counter()
            for bones, n in zip(batch["bones"], batch["n"], strict=True):
                for form, weight in forms(bones):
                    counts[form] += n * weight
            yield pd.DataFrame({"form": list(counts), "n": [float(x) for x in counts.values()]}, columns=["form", "n"])

    return run


def _rarely_cut(bones: str) -> list[tuple[str, float]]:
    """Forms of the values that the rarer delimiters cut; those of a field without any count little."""
    text, shield = _prepared(bones)
    forms = [form for form in (_form(text[a:b]) for a, b in _pieces(text, [(0, len(text))], _RARE, shield)) if form]
    return [(form, 1.0 if len(forms) > 1 else SINGLE_WEIGHT) for form in forms]


@lru_cache(maxsize=MEMORY)
def _form(stretch: str) -> str:
    """The form of the value in a stretch; empty when it holds none."""
    value = _clean(stretch)
    return form_of(value) if _is_value(value) else ""


def _chosen(codes: Codes) -> Callable[[], Callable[[str], list[tuple[str, float]]]]:
    def made() -> Callable[[str], list[tuple[str, float]]]:
        parse = Parser(codes).parse
        return lambda bones: [(form, 1.0) for _, _, form in parse(bones)]

    return made


def _codes(counts: DataFrame) -> Codes:
    """Code lengths of the forms; at most 1/MIN_SHARE of them reach the driver."""
    sums = cut(counts.groupBy("form").agg(F.sum("n").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0.0
    kept = sums.filter(F.col("n") >= F.lit(total * MIN_SHARE)).collect() if total else []
    return {row["form"]: -math.log2(row["n"] / total) for row in kept}


def dialect_codes(fields: DataFrame) -> Codes:
    """Code lengths of value forms over all of ``fields`` (column ``text``)."""
    texts = fields.select("text").filter("text IS NOT NULL")
    bones = cut(texts.mapInPandas(_count_skeletons, "bones string, n bigint").groupBy("bones").agg(F.sum("n").alias("n")))
    first = _codes(bones.mapInPandas(_count_forms(lambda: _rarely_cut), "form string, n double"))
    return _codes(bones.mapInPandas(_count_forms(_chosen(first)), "form string, n double"))


def packed_fields(df: DataFrame, id_column: str, field_column: str) -> DataFrame:
    """(record_id, text) of a table; other columns are not read."""
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("record_id"), F.col(f"`{field_column}`").cast("string").alias("text"))


def unpack(fields: DataFrame, codes: Codes | None = None, least: int = 1) -> DataFrame:
    """(record_id, pos, value): the values of every field that holds at least ``least`` of them.

    ``pos`` counts from 1. Null, blank and stand-in fields give no row; empty places and signs for
    left-out names are no values; repeated rows are parsed each; a text of any length is parsed
    whole; an empty table gives no rows.
    """
    codes = dialect_codes(fields) if codes is None else codes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(codes)
        for batch in batches:
            ids, places, values = [], [], []
            for record, text in zip(batch["record_id"], batch["text"], strict=True):
                found = parser.values(text)
                if len(found) >= least:
                    ids += [record] * len(found)
                    places += range(1, len(found) + 1)
                    values += found
            yield pd.DataFrame({"record_id": pd.array(ids, "Int64"), "pos": pd.array(places, "Int32"), "value": pd.array(values, "string")})

    return fields.filter("text IS NOT NULL").mapInPandas(run, "record_id bigint, pos int, value string")


def values_count(column: Column, codes: Codes) -> Column:
    """How many values a packed column holds; null stays null."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parser = Parser(codes)
        for texts in batches:
            yield pd.Series([None if text is None else parser.count(text) for text in texts], dtype="Int32")

    return count(column)
