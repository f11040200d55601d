"""Problem 1: the structural loader against a plain reading of the rules, and its edges."""

import random
import re

import pytest

from stackmill.operators.raw_records import load_raw_records, loaded_entries, rejected_records

YEAR = re.compile(r"(?<![0-9A-Za-z_])(1[89]\d\d|20\d\d)(?![0-9A-Za-z_])")
DOI = re.compile(r"(?i:doi\s*:?\s*)?10\.\d{4,9}/\S+")


def ris_valid(raw):
    lines = [x.rstrip() for x in re.split(r"[\r\n]", raw) if x.strip()]
    if not lines or any(not re.fullmatch(r"[A-Z][A-Z0-9]  -( .+)?", x) for x in lines):
        return False
    tags = [x[:2] for x in lines]
    value = lambda x: x[5:].strip()
    return tags[0] == "TY" and tags[-1] == "ER" and tags.count("TY") == tags.count("ER") == 1 and all(YEAR.search(value(x)) for x in lines if x[:2] == "PY") and all(DOI.fullmatch(value(x)) for x in lines if x[:2] == "DO") and all(re.fullmatch(r"(?i:https?)://[^\s/?#]+\S*", value(x)) for x in lines if x[:2] == "UR")


def bibtex_valid(raw):
    m = re.match(r"@(article|book|inproceedings)\s*\{", raw.strip(), re.I)
    if not m:
        return False
    text, depth, quoted, parts, at = raw.strip(), 1, False, [], m.end()
    for i in range(m.end(), len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                if i != len(text) - 1 or quoted:
                    return False
                parts.append(text[at:i])
        elif c == '"' and depth == 1:
            quoted = not quoted
        elif c == "," and depth == 1 and not quoted:
            parts.append(text[at:i])
            at = i + 1
    if depth:
        return False
    key, fields = parts[0].strip(), parts[1:]
    if fields and not fields[-1].strip():
        fields = fields[:-1]
    if not key or re.search(r'[={"]', key) or not fields:
        return False
    for f in fields:
        m = re.match(r"\s*([A-Za-z][A-Za-z0-9_:.+-]*)\s*=\s*(.*?)\s*$", f, re.S)
        if not m or not m.group(2):
            return False
        v = m.group(2)
        if v[0] == "{":
            depth, ends = 0, []
            for i, c in enumerate(v):
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    ends.append(i)
            if ends[0] != len(v) - 1:
                return False
            inner = v[1:-1]
        elif v[0] == '"':
            depth, marks = 0, []
            for i, c in enumerate(v):
                depth += (c == "{") - (c == "}")
                if c == '"' and depth == 0:
                    marks.append(i)
            if marks != [0, len(v) - 1]:
                return False
            inner = v[1:-1]
        elif re.fullmatch(r"[^\s{}\",=#%~\\']+", v):
            inner = v
        else:
            return False
        name = m.group(1).lower()
        if name == "year" and not YEAR.search(inner) or name == "doi" and not DOI.fullmatch(inner.strip()):
            return False
    return True


def test_equals_plain_reading_on_all_records_and_on_damaged_ones(spark, folder):
    rows = [(r["record_id"], r["fmt"], r["raw"]) for r in spark.read.parquet(f"{folder}/raw_records.parquet").collect()]
    rng, number = random.Random(5), 10**9
    for _, fmt, raw in list(rows):
        for _ in range(8):
            i = rng.randrange(len(raw))
            damaged = rng.choice([raw[:i] + raw[i + 1 :], raw[:i] + rng.choice('{}",=\n -@x2') + raw[i:], raw[:i], raw[i:]])
            rows.append((number := number + 1, fmt, damaged))
    got = {r["record_id"]: r["valid"] for r in load_raw_records(spark.createDataFrame(rows, "record_id long, fmt string, raw string")).collect()}
    wrong = [(i, raw, got[i]) for i, fmt, raw in rows if got[i] != (ris_valid if fmt == "ris" else bibtex_valid)(raw)]
    assert not wrong, wrong[:3]
    assert 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize(
    ("fmt", "raw", "reason"),
    [
        ("ris", None, "record is null"),
        ("ris", " \n ", "empty record"),
        ("bibtex", "", "empty record"),
        (None, "TY  - JOUR\nER  -", "format is not known"),
        ("csv", "a,b", "format is not known"),
        ("ris", "TY  - JOUR\nER  - ", None),
        ("RIS ", "TY  - JOUR\r\n\r\nPY  - Spring 1997///\r\nER  -", None),
        ("ris", "TY  - JOUR\nPY  -\nER  -", "year is not a full year"),
        ("bibtex", '@article{k, title = "a {"} b", year = 2001,}', None),
        ("bibtex", "@article{k, title = {a}, }}", "text after the entry is closed"),
        ("bibtex", "@article{k}", "no fields"),
        ("bibtex", "@article{k, a = {b} {c}}", "a value is not in braces, in quotation marks or one bare word"),
        ("ris", "TY  - JOUR\nAB  - " + "x" * 300_000 + "\nER  -", None),
    ],
)
def test_edges(spark, fmt, raw, reason):
    row = load_raw_records(spark.createDataFrame([(1, fmt, raw)], "record_id long, fmt string, raw string")).first()
    assert (row["valid"], row["reason"]) == (reason is None, reason)


def test_fields_repeats_clashing_columns_and_empty_table(spark):
    raw = "TY  - JOUR\nTI  - T\nAU  - A, B\nA1  - C, D\nPY  - 1999/1/\nDO  - doi:10.1234/x\nUR  - https://h/x\nER  -"
    df = spark.createDataFrame([(1, "ris", raw, "mine", True), (1, "ris", raw, None, None), (None, "ris", raw, None, None)], "record_id long, fmt string, raw string, reason string, valid boolean")
    rows = loaded_entries(load_raw_records(df)).collect()
    assert len(rows) == 3 and rows[0]["authors"] == ["A, B", "C, D"] and rows[0]["year"] == 1999 and rows[0]["title"] == "T"
    assert rejected_records(load_raw_records(df)).count() == 0 and load_raw_records(df.limit(0)).count() == 0
