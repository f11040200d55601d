"""Text parsing: the contract of mixed inputs, bibliographies, BibTeX and RIS."""

import pytest

from stackmill.functions import grammar
from stackmill.operators import parsing


def kinds(text):
    found = grammar.parse(text)
    return [kind for _, kind, _, _ in found.items], found.skipped


@pytest.mark.parametrize(
    ("text", "want", "skipped"),
    [
        ("https://example.org/p.pdf\n10.5555/alpha\nHolm, K. (2024). Known Reference. Journal.\n@article{k, title={A Title}, author={Doe, R.}, year={2023}, doi={10.5555/beta}}", ["doi", "doi", "url", "reference", "bibtex", "reference"], 0),
        ("one, two, three, four, five, six", [], 1),
        ("References\n1. Holm, K. (2024). Title One. Journal.\n2) Jones, K. (2023). Title Two. Journal.", ["reference"] * 2, 0),
        ("Holm, K. (2024). Title one.\nJournal Name, 1(2), 3-4.\n\nJones, K. (2023). Title two.\nOther Journal, 5(6), 7-8.", ["reference"] * 2, 0),
        ("References:\n1. Holm, K. (2024). Title. Journal. https://doi.org/10.5555/x1\n2. Jones, K. (2023). More. Journal. https://example.org/p.pdf", ["doi", "url", "reference", "reference"], 0),
        ("10.5555/shared\n@article{k, title={T t}, author={Holm, K.}, year={2024}, doi={10.5555/shared}}", ["doi", "bibtex", "reference"], 0),
        ("@article{bad, title={Broken}, year={2024}\n@article{ok, title={Good}, author={Holm, K.}, year={2024}, doi={10.5555/good}}", ["doi", "bibtex", "reference"], 1),
        ("@comment{x}\n@string{a = {b}}\n@misc{k, title={T}}", [], 1),
        ("@article{k, title={\"quoted } brace\"}, year=2020}\n", ["bibtex", "reference"], 0),
        ("https://example.org/1 https://example.org/1", ["url", "url"], 0),
        ("https://doi.org/10.5555/y", ["doi"], 0),
        ("", [], 0),
        ("   \n\n", [], 0),
    ],
)
def test_contract(text, want, skipped):
    found, left = kinds(text)
    assert found == want and len(left) == skipped


def test_bibtex_entry_forms():
    entry = grammar.bibtex_entry('@Book{ key1 , Title = "A \\"quoted\\" word", author={Ann Lee and  Bo Roe}, author={Other}, year = "in 2019", }')
    assert (entry.entry_type, entry.key, entry.authors, entry.year, entry.fields["title"]) == ("book", "key1", "Ann Lee, Bo Roe", "2019", 'A "quoted" word')
    for broken in ("@article{, a={b}}", "@article{k}", "@article{k, a}", "@article{k, a={b}", "@misc{k, a={b}}"):
        said = grammar.bibtex_entry(broken)
        assert said.startswith("What: ") and "Why: " in said and "Fix: " in said


def test_long_inputs_are_parsed_whole():
    text = "\n".join(f"10.5555/n{i} https://example.org/{i}" for i in range(20_000))
    found = grammar.parse(text)
    assert len(found.items) == 40_000 and not found.skipped


def test_references(spark):
    rows = [
        (1, "19990 Holm, K., Lee, Anna (1999). Deep parts. Journal."),
        (2, "[3] Roe et al. 2015 Short one here"),
        (3, "nothing to see"),
        (4, "(1750) A title of old times. (1850). Newer"),
        (5, 'Holm, K. (2020). "Quoted title". Journal of X.'),
        (6, "in (9999) and 1875"),
    ]
    got = {r["input_id"]: r for r in parsing.references(spark.createDataFrame(rows, "input_id long, text string")).collect()}
    assert (got[1]["authors"], got[1]["year"], got[1]["title"], got[1]["confidence"]) == (["Holm, K.", "Lee, Anna"], 1999, "Deep parts", "high")
    assert got[2]["authors"] == ["Roe et al."] and got[2]["year"] == 2015 and got[3]["confidence"] == "low"
    assert got[4]["year"] == 1850 and got[5]["title"] == "Quoted title" and got[6]["year"] == 1875


def test_bibliographies_agree_with_running_text(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS input_id", "text")
    got: dict[int, list[str]] = {}
    for r in parsing.bibliography_entries(texts).orderBy("input_id", "entry_no").collect():
        got.setdefault(r["input_id"], []).append(r["entry"])
    want = {r["input_id"]: found for r in texts.collect() if (found := grammar.bibliography(r["text"] or ""))}
    assert got == want and len(want) > 3


def test_headings_and_signs_are_no_entries(spark):
    text = "\n".join(f"{h}\n{h.upper()}:" for h in grammar.HEADINGS) + "\n-----\n***\nHolm, K. (2001). A work of note. Press."
    assert [r["entry"] for r in parsing.bibliography_entries(spark.createDataFrame([(1, text)], "input_id long, text string")).collect()] == ["Holm, K. (2001). A work of note. Press."]
    assert grammar.bibliography(text) == ["Holm, K. (2001). A work of note. Press."]


def test_summary_and_uncertain(spark):
    rows = [(1, "1. Holm, K. (2024). Valid title. Journal.\n2. one, two, three, four, five, six")]
    found = parsing.bibliographies(spark.createDataFrame(rows, "input_id long, text string"))
    assert tuple(parsing.bibliography_summary(found).first()) == (2, 1, 1)


def test_ris(spark):
    text = "TY  - JOUR\nTI  - First\nAU  - A\nAU  - B\nPY  - 2001/05\nDO  - see doi:10.5555/x).\nUR  - https://x.example\nER  - \nER  - \nTY  - BOOK\nTI  - Cut off\nTY  - CHAP\nUR  - https://y.example\nT1  - not read\nER  -\nTY  -\nER  -"
    records = parsing.ris_records(spark.createDataFrame([(1, text), (2, "no records"), (3, None)], "input_id long, text string"))
    got = {r["record_no"]: r for r in parsing.ris_entries(records).collect()}
    assert (got[1]["title"], got[1]["authors"], got[1]["year"], got[1]["doi"]) == ("First", ["A", "B"], 2001, "10.5555/x")
    assert got[2]["problem"] == "not closed by an end line" and got[3]["title"] is None and got[4]["problem"] == "no type"
    items = sorted((r["record_no"], r["ord"], r["kind"], r["value"]) for r in parsing.ris_items(parsing.ris_entries(records)).collect())
    assert items == [(1, 1, "doi", "10.5555/x"), (1, 2, "reference", "A, B (2001) First."), (2, 1, "skipped", "not closed by an end line"), (3, 1, "url", "https://y.example"), (4, 1, "skipped", "no type")]
