"""Loading raw RIS and BibTeX records: valid ones become entries, the rest keep the reason they failed.

The grammar is checked by structural indexing (``functions.structural``): per Arrow batch, masks
over the bytes find line ends, braces and quotation marks; prefix sums of the masks give nesting
depth and quote parity; counts and slices of them give every check. There is no shuffle and no
state beyond one batch, so the operator scales with the number of input splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions.structural import SPACE, UPPER, UPPER_OR_DIGIT, byte_view, gather, line_index, trim

# Fixed values of the two formats.
YEAR_RE = r"(^|[^0-9A-Za-z_])(1[89][0-9]{2}|20[0-9]{2})([^0-9A-Za-z_]|$)"
DOI_RE = r"^(?i:doi\s*:?\s*)?10\.[0-9]{4,9}/\S+$"
HTTP_RE = r"^(?i:https?)://[^\s/?#]+\S*$"
NAME_RE = r"^[A-Za-z][A-Za-z0-9_:.+-]*$"
BARE_RE = r"^[^\s{}\",=#%~\\']+$"
BIBTEX_TYPES = ["article", "book", "inproceedings"]

RESULT = pa.schema(
    [
        ("record_id", pa.int64()),
        ("fmt", pa.string()),
        ("raw", pa.string()),
        ("valid", pa.bool_()),
        ("reason", pa.string()),
        ("entry_type", pa.string()),
        ("entry_key", pa.string()),
        ("title", pa.string()),
        ("authors", pa.list_(pa.string())),
        ("year", pa.int32()),
        ("doi", pa.string()),
        ("url", pa.string()),
    ]
)
RESULT_DDL = "record_id bigint, fmt string, raw string, valid boolean, reason string, entry_type string, entry_key string, title string, authors array<string>, year int, doi string, url string"


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(values, pattern))


class _Verdict:
    """The first failure of each record, by order of the checks."""

    def __init__(self, n: int) -> None:
        self.reason = np.full(n, None, dtype=object)

    def fail(self, records: np.ndarray, why: str) -> None:
        """``records``: their numbers, or a mask over all."""
        records = np.flatnonzero(records) if records.dtype == bool else np.unique(records)
        records = records[np.equal(self.reason[records], None)]
        self.reason[records] = why


class _Fields:
    """Values found in a batch, by record; the first of a name wins, authors keep all."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.columns: dict[str, list] = {k: [None] * n for k in ("entry_type", "entry_key", "title", "year", "doi", "url")}
        self.authors: list[list[str] | None] = [None] * n

    def first(self, name: str, records: np.ndarray, values: list[str]) -> None:
        column = self.columns[name]
        for r, v in zip(records.tolist(), values, strict=True):
            if column[r] is None and v:
                column[r] = v


def _year(text: pa.Array) -> list[int | None]:
    found = pc.extract_regex(text, r"(?:^|[^0-9A-Za-z_])(?P<year>1[89][0-9]{2}|20[0-9]{2})(?:[^0-9A-Za-z_]|$)")
    return [int(x["year"]) if x else None for x in found.to_pylist()]


def _ris(data: np.ndarray, offsets: np.ndarray) -> tuple[_Verdict, _Fields]:
    n = len(offsets) - 1
    verdict, fields = _Verdict(n), _Fields(n)
    rec, start, end = line_index(data, offsets)
    lines = np.bincount(rec, minlength=n)
    verdict.fail(lines == 0, "empty record")
    if len(rec) == 0:
        return verdict, fields
    at = np.concatenate([data, np.full(6, 10, np.uint8)])
    length = end - start
    tagged = (length >= 5) & UPPER[at[start]] & UPPER_OR_DIGIT[at[start + 1]] & (at[start + 2] == 32) & (at[start + 3] == 32) & (at[start + 4] == 45) & ((length == 5) | (at[start + 5] == 32))
    tag = np.where(tagged, at[start].astype(np.int32) * 256 + at[start + 1], 0)
    code = lambda t: ord(t[0]) * 256 + ord(t[1])
    first = np.ones(len(rec), bool)
    first[1:] = rec[1:] != rec[:-1]
    last = np.ones(len(rec), bool)
    last[:-1] = first[1:]
    ty, er = tag == code("TY"), tag == code("ER")
    verdict.fail(rec[first & ~ty], "no type line at the start")
    verdict.fail(rec[last & ~er], "not closed by an end line")
    verdict.fail(np.bincount(rec[ty], minlength=n) > 1, "more than one type line")
    verdict.fail(np.bincount(rec[er], minlength=n) > 1, "more than one end line")
    verdict.fail(rec[~tagged], "a line that is not a tag")
    value_start, value_end = trim(data, np.minimum(start + 5, end), end)
    for name, pattern, why in (("PY", YEAR_RE, "year is not a full year"), ("DO", DOI_RE, "DOI is not well formed"), ("UR", HTTP_RE, "address is not well formed")):
        of = np.flatnonzero(tag == code(name))
        if len(of):
            verdict.fail(rec[of[~_matches(gather(data, value_start[of], value_end[of]), pattern)]], why)
    take = lambda *tags: np.flatnonzero(np.isin(tag, [code(t) for t in tags]))
    for name, tags in (("entry_type", ("TY",)), ("title", ("TI", "T1")), ("doi", ("DO",)), ("url", ("UR",))):
        of = take(*tags)
        fields.first(name, rec[of], gather(data, value_start[of], value_end[of]).to_pylist())
    of = take("PY", "Y1")
    fields.first("year", rec[of], _year(gather(data, value_start[of], value_end[of])))
    of = take("AU", "A1")
    for r, v in zip(rec[of].tolist(), gather(data, value_start[of], value_end[of]).to_pylist(), strict=True):
        if v:
            fields.authors[r] = [*(fields.authors[r] or []), v]
    return verdict, fields


def _bibtex(data: np.ndarray, offsets: np.ndarray) -> tuple[_Verdict, _Fields]:
    n = len(offsets) - 1
    verdict, fields = _Verdict(n), _Fields(n)
    if len(data) == 0:
        verdict.fail(np.ones(n, bool), "empty record")
        return verdict, fields
    begin, stop = trim(data, offsets[:-1], offsets[1:])
    verdict.fail(stop <= begin, "empty record")
    full = stop > begin
    rec = np.repeat(np.arange(n), np.diff(offsets))
    opens, closes = data == 123, data == 125
    total = np.cumsum(opens.astype(np.int32) - closes)
    base = np.where(offsets[:-1] > 0, total[np.maximum(offsets[:-1] - 1, 0)], 0)
    depth = total - base[rec]  # after the byte
    # A quotation mark counts only at depth 1; within braces it is text.
    quote = (data == 34) & (depth == 1)
    marks = np.cumsum(quote)
    mark_base = np.where(offsets[:-1] > 0, marks[np.maximum(offsets[:-1] - 1, 0)], 0)
    outside = ((marks - mark_base[rec]) & 1) == 0  # even parity after the byte
    plain = (depth == 1) & outside & ~quote
    safe_stop = np.maximum(stop - 1, 0)

    at_sign = data[np.minimum(begin, len(data) - 1)] == 64
    verdict.fail(full & ~at_sign, "does not begin with @")
    opened = np.flatnonzero(opens)
    k = np.searchsorted(opened, begin, "left")
    has_open = (k < len(opened)) & (opened[np.minimum(k, max(len(opened) - 1, 0))] < stop) if len(opened) else np.zeros(n, bool)
    verdict.fail(full & ~has_open, "no opening brace")
    head_end = np.where(has_open, opened[np.minimum(k, len(opened) - 1)] if len(opened) else 0, begin)
    head = pc.utf8_lower(gather(data, *trim(data, np.minimum(begin + at_sign, head_end), head_end)))
    verdict.fail(full & has_open & ~np.asarray(pc.is_in(head, value_set=pa.array(BIBTEX_TYPES, pa.large_string()))), "entry type is not known")
    fields.first("entry_type", np.arange(n), head.to_pylist())

    closed = np.flatnonzero(closes & (depth <= 0))
    c = np.searchsorted(closed, head_end, "left")
    has_close = (c < len(closed)) & (closed[np.minimum(c, max(len(closed) - 1, 0))] < stop) if len(closed) else np.zeros(n, bool)
    close = np.where(has_close, closed[np.minimum(c, len(closed) - 1)] if len(closed) else 0, stop)
    verdict.fail(full & has_open & ~has_close, "braces are not closed")
    verdict.fail(full & has_open & has_close & (close != safe_stop), "text after the entry is closed")
    verdict.fail(full & has_open & has_close & ~outside[np.maximum(close - 1, 0)], "a quotation mark is not closed")

    # Parts between the commas at depth 1 outside quotation marks: the key, then the fields.
    body = full & has_open & has_close & (head_end + 1 <= close)
    commas = np.flatnonzero((data == 44) & plain)
    comma_rec = rec[commas]
    inside = body[comma_rec] & (commas > head_end[comma_rec]) & (commas < close[comma_rec])
    commas, comma_rec = commas[inside], comma_rec[inside]
    parts_rec = np.concatenate([np.flatnonzero(body), comma_rec])
    parts_start = np.concatenate([head_end[body] + 1, commas + 1])
    order = np.lexsort((parts_start, parts_rec))
    parts_rec, parts_start = parts_rec[order], parts_start[order]
    if len(parts_rec) == 0:
        return verdict, fields
    lead = np.ones(len(parts_rec), bool)
    lead[1:] = parts_rec[1:] != parts_rec[:-1]
    tail = np.ones(len(parts_rec), bool)
    tail[:-1] = lead[1:]
    parts_end = np.where(tail, close[parts_rec], np.append(parts_start[1:] - 1, 0))
    s, e = trim(data, parts_start, parts_end)
    empty = e <= s
    equals = np.flatnonzero((data == 61) & plain)
    q = np.searchsorted(equals, s, "left")
    eq = np.where(q < len(equals), equals[np.minimum(q, max(len(equals) - 1, 0))] if len(equals) else len(data), len(data))
    has_eq = eq < e
    special = np.cumsum(opens | (data == 34))
    count_special = lambda a, b: special[np.maximum(b - 1, 0)] - np.where(a > 0, special[np.maximum(a - 1, 0)], 0)
    verdict.fail(parts_rec[lead & empty], "key is missing")
    verdict.fail(parts_rec[lead & ~empty & (has_eq | (count_special(s, e) > 0))], "key is missing")
    fields.first("entry_key", parts_rec[lead], gather(data, s[lead], e[lead]).to_pylist())
    field_count = np.bincount(parts_rec[~lead & ~empty], minlength=n)
    verdict.fail(body & (field_count == 0), "no fields")
    verdict.fail(parts_rec[~lead & empty & ~tail], "two commas without a field between")
    field = ~lead & ~empty
    verdict.fail(parts_rec[field & ~has_eq], "a field without an equals sign")
    f = np.flatnonzero(field & has_eq)
    if len(f) == 0:
        return verdict, fields
    fr, fs, fe, fq = parts_rec[f], s[f], e[f], eq[f]
    names = gather(data, *trim(data, fs, fq))
    verdict.fail(fr[~_matches(names, NAME_RE)], "a field name is not well formed")
    vs, ve = trim(data, fq + 1, fe)
    none = ve <= vs
    verdict.fail(fr[none], "a field without a value")
    vs_, ve_ = np.minimum(vs, len(data) - 1), np.maximum(ve - 1, 0)
    back = np.flatnonzero((closes & (depth == 1)))  # where a braced value returns to depth 1
    b = np.searchsorted(back, vs, "left")
    first_back = np.where(b < len(back), back[np.minimum(b, max(len(back) - 1, 0))] if len(back) else -1, -1)
    braced = ~none & (data[vs_] == 123)
    quoted = ~none & (data[vs_] == 34)
    quotes_in = marks[ve_] - np.where(vs > 0, marks[np.maximum(vs - 1, 0)], 0)
    good_braced = braced & (first_back == ve_)
    good_quoted = quoted & (data[ve_] == 34) & (ve_ > vs) & (quotes_in == 2)
    content_start = np.where(good_braced | good_quoted, vs + 1, vs)
    content_end = np.where(good_braced | good_quoted, ve - 1, ve)
    bare = ~none & ~braced & ~quoted
    good_bare = bare.copy()
    good_bare[bare] = _matches(gather(data, vs[bare], ve[bare]), BARE_RE)
    verdict.fail(fr[~none & ~(good_braced | good_quoted | good_bare)], "a value is not in braces, in quotation marks or one bare word")
    content = pc.utf8_trim_whitespace(gather(data, content_start, content_end))
    lower = np.asarray(pc.utf8_lower(names).to_pylist(), dtype=object)
    for name, pattern, why in (("year", YEAR_RE, "year is not a full year"), ("doi", DOI_RE, "DOI is not well formed")):
        of = np.flatnonzero(lower == name)
        if len(of):
            verdict.fail(fr[of[~_matches(content.take(pa.array(of)), pattern)]], why)
    for name in ("title", "doi", "url"):
        of = np.flatnonzero(lower == name)
        fields.first(name, fr[of], content.take(pa.array(of)).to_pylist())
    of = np.flatnonzero(lower == "year")
    fields.first("year", fr[of], _year(content.take(pa.array(of))))
    of = np.flatnonzero(lower == "author")
    for r, v in zip(fr[of].tolist(), pc.split_pattern_regex(content.take(pa.array(of)), r"\s+and\s+").to_pylist(), strict=True):
        if fields.authors[r] is None:
            fields.authors[r] = [x.strip() for x in v if x.strip()] or None
    return verdict, fields


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        fmt = np.asarray(pc.fill_null(pc.utf8_lower(pc.utf8_trim_whitespace(batch.column("fmt").cast(pa.string()))), "").to_pylist(), dtype=object)
        reason = np.full(n, "format is not known", dtype=object)
        out = {k: np.full(n, None, dtype=object) for k in ("entry_type", "entry_key", "title", "authors", "year", "doi", "url")}
        for name, parse in (("ris", _ris), ("bibtex", _bibtex)):
            of = np.flatnonzero(fmt == name)
            if len(of) == 0:
                continue
            verdict, fields = parse(*byte_view(batch.column("raw").take(pa.array(of))))
            reason[of] = verdict.reason
            good = np.equal(verdict.reason, None)
            for k, column in (*fields.columns.items(), ("authors", fields.authors)):
                for i in np.flatnonzero(good).tolist():
                    out[k][of[i]] = column[i]
        reason[np.asarray(pc.is_null(batch.column("raw")))] = "record is null"
        valid = np.equal(reason, None)
        for k in out:
            out[k][~valid] = None
        columns = [batch.column("record_id").cast(pa.int64()), batch.column("fmt").cast(pa.string()), batch.column("raw").cast(pa.string()), pa.array(valid), pa.array(reason.tolist(), pa.string())]
        columns += [pa.array(out[f.name].tolist(), f.type) for f in list(RESULT)[5:]]
        yield pa.RecordBatch.from_arrays(columns, schema=RESULT)


def load_raw_records(df: DataFrame, id_column: str = "record_id", fmt_column: str = "fmt", raw_column: str = "raw") -> DataFrame:
    """Parse every record; one output row per input row.

    Output: record_id, fmt, raw, valid, reason (null when valid), entry_type, entry_key, title,
    authors, year, doi, url (null when not valid). A null or blank ``raw`` fails as ``record is
    null`` or ``empty record``; a null or other ``fmt`` fails as ``format is not known``. Repeated
    rows stay repeated, whatever the length of a text; an empty table gives an empty one. Only the
    three named columns are read, so other columns of any name neither pass through nor clash.
    """
    pick: list[Column] = [F.col(f"`{id_column}`").cast("bigint").alias("record_id"), F.col(f"`{fmt_column}`").alias("fmt"), F.col(f"`{raw_column}`").alias("raw")]
    return df.select(*pick).mapInArrow(_batches, RESULT_DDL)


def loaded_entries(parsed: DataFrame) -> DataFrame:
    """The valid records as entries."""
    return parsed.filter("valid").drop("valid", "reason", "raw")


def rejected_records(parsed: DataFrame) -> DataFrame:
    """The records set apart, each with its reason and its text."""
    return parsed.filter("NOT valid").select("record_id", "fmt", "reason", "raw")
