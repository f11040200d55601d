"""Text, sidecar, registry and history sources and the sinks that mirror them."""

import json

import pytest

from stackmill.operators import exports
from stackmill.sources import files
from stackmill.sources.tables import table


def test_bibliographies_and_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bib").write_text("@article{k,\n}")
    (tmp_path / "sub" / "b.ris").write_text("TY  - JOUR\nER  - ")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub" / "d.MD").write_text("see https://x.org")
    found = {r["path"].rsplit("/", 1)[-1]: (r["fmt"], r["text"]) for r in files.bibliography_files(spark, str(tmp_path)).collect()}
    assert found == {"a.bib": ("bibtex", "@article{k,\n}"), "b.ris": ("ris", "TY  - JOUR\nER  - ")}
    assert [r["text"] for r in files.markdown_files(spark, str(tmp_path)).collect()] == ["see https://x.org"]


def test_sidecars_skip_broken_and_other_types(spark, tmp_path):
    good = {"@type": "ScholarlyArticle", "name": "T", "author": [{"@type": "Person", "name": "A B"}], "identifier": {"value": "10.1/x"}}
    (tmp_path / "1.json").write_text(json.dumps(good))
    (tmp_path / "2.json").write_text(json.dumps({"@type": "Book", "name": "U"}))
    (tmp_path / "3.json").write_text("{broken")
    rows = exports.read_sidecars(files.sidecar_files(spark, str(tmp_path))).collect()
    assert [(r["title"], r["authors"], r["doi"], r["url"]) for r in rows] == [("T", ["A B"], "10.1/x", None)]


@pytest.mark.parametrize(("version", "project", "rows"), [(1, "p", 1), (2, "p", 0), (1, "other", 0)])
def test_registry_versions(spark, tmp_path, version, project, rows):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"schema_version": version, "project_key": project, "items": [{"dedup_key": "doi:x", "relative_path": "a.pdf"}]}))
    assert files.registry(spark, str(path), "p").count() == rows


def test_topics_file(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text(" tidal \n\n# note\nfrost\n")
    assert [r["topic"] for r in files.custom_topics(spark, str(path)).collect()] == ["tidal", "frost"]


def test_sinks_keep_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:03d}", f"line {i}") for i in range(50)], "path string, entry string")
    files.write_rows(rows, "entry", "path", str(tmp_path / "out"), "\n\n")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.strip().split("\n\n") == [f"line {i}" for i in range(50)]
    files.write_registry(rows.selectExpr("path AS dedup_key", "entry"), str(tmp_path / "reg"))
    assert spark.read.json(str(tmp_path / "reg")).count() == 50


def test_histories_keep_their_source(spark, tmp_path, folder):
    log = table(spark, folder, "download_log")
    log.limit(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "download_log.parquet").write_bytes(next((tmp_path / "a").glob("part-*.parquet")).read_bytes())
    found = files.histories(spark, str(tmp_path))
    assert found.count() == 10 and found.select("source").distinct().count() == 2
    files.append_log(log.limit(5), str(tmp_path / "log"))
    files.append_log(log.limit(5), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
