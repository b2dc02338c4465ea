"""Files as tables, reports, backups."""

import pytest

from corpusloom.sources import vault as V


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"A/x.md": "# X\r\nbody", "A/B/y.MD": "y", ".git/z.md": "no", "A/.hidden/h.md": "no", "A/scripts/s.md": "no", "doc.pdf": "%PDF", "pic.png": "p"}.items():
        f = tmp_path / "vault" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path / "vault")


def test_scan_and_statuses(spark, folder):
    files = V.scan(spark, folder)
    assert sorted(r.path for r in files.collect()) == ["A/B/y.MD", "A/x.md", "doc.pdf", "pic.png"]
    assert {r.path: r.status for r in V.source_report(files).collect()} == {"A/x.md": "ingested", "A/B/y.MD": "ingested", "doc.pdf": "parse_failed", "pic.png": "unsupported"}
    texts = {r.path: r.text for r in V.read_markdown(spark, folder).collect()}
    assert texts == {"A/x.md": "# X\r\nbody", "A/B/y.MD": "y"}


def test_files_of_one_name_in_nested_folders(spark, tmp_path):
    for name in ("A/x.md", "B/A/x.md", "B/(odd) [folder]+/x.md"):
        f = tmp_path / "a.b (v)" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"text of {name}")
    got = sorted((r.path, r.text) for r in V.read_markdown(spark, str(tmp_path / "a.b (v)")).collect())
    assert got == [(n, f"text of {n}") for n in ("A/x.md", "B/(odd) [folder]+/x.md", "B/A/x.md")]


def test_parsers_are_called_and_their_failures_are_statuses(spark, folder):
    def words_of_pdf(raw):
        if raw.startswith(b"%PDF"):
            return raw.decode()[1:]
        raise ValueError("no PDF")

    got = {r.path: (r.status, r.text) for r in V.parsed(spark, folder, {"pdf": words_of_pdf, "png": lambda raw: 1 / 0}).collect()}
    assert got == {"A/x.md": ("ingested", "# X\r\nbody"), "A/B/y.MD": ("ingested", "y"), "doc.pdf": ("ingested", "PDF"), "pic.png": ("parse_failed", None)}
    assert {r.path: r.status for r in V.parsed(spark, folder, {}).collect()}["doc.pdf"] == "unsupported"


def test_incremental_and_upsert(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, content_hash string")
    assert sorted(r.path for r in V.to_ingest(now, stored).collect()) == ["b", "c"]
    assert sorted(map(tuple, V.upsert(stored, now, key="path").collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_backup_refuses_changed_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    V.backup({"t": df}, str(tmp_path / "b"))
    assert V.restore(spark, str(tmp_path / "b"))["t"].count() == 2
    df.limit(1).write.mode("append").parquet(str(tmp_path / "b" / "t"))
    with pytest.raises(ValueError):
        V.restore(spark, str(tmp_path / "b"))
    V.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
