"""Downloads, the prompt store and job rows on small tables, edge cases among them."""

import json

import pytest

from ratlas.operators import jobs, prompts, sessions
from ratlas.sources import downloads, folders, sinks

URL = "url string"


def test_fetch_once_and_again(spark, tmp_path):
    log = tmp_path / "log"

    def fetch(url):
        with log.open("a") as f:
            f.write(url + "\n")
        if url == "broken" or (url == "late" and log.read_text().count("late\n") < 2):
            raise OSError("gone")
        return b"12345", {"Content-Length": "x", "ETag": "e"}

    rows = spark.createDataFrame([("a",), ("a",), ("late",), ("broken",), (None,), ("",)], URL)
    got = {r.url: r for r in downloads.fetched(rows, fetch, most=5, attempts=2, wait=0).collect()}
    assert set(got) == {"a", "late", "broken"}
    assert bytes(got["a"].content) == b"12345" and got["a"].headers["etag"] == "e" and got["late"].error is None
    assert got["broken"].content is None and got["broken"].error == "gone" and got["broken"].headers == {}
    assert sorted(log.read_text().split()) == ["a", "broken", "broken", "late", "late"]


def test_size_limits(spark):
    rows = spark.createDataFrame([("4",), ("5",)], URL)
    got = {r.url: r for r in downloads.fetched(rows, lambda u: (b"x" * int(u), {}), most=4).collect()}
    assert got["4"].error is None and got["5"].content is None and got["5"].error == "document exceeds size limit (5 > 4 bytes)"
    said = downloads.fetched(rows, lambda u: (b"", {"content-length": str(26 * 1024 * 1024)})).collect()
    assert all(r.large and r.error is None for r in said)


def test_nothing_to_fetch(spark):
    none = spark.createDataFrame([], URL)
    assert downloads.fetched(none, lambda u: (b"", {})).count() == 0
    assert downloads.probed(none, lambda u: {}).count() == 0


def test_raw_pages_land_by_year(spark, tmp_path):
    pages = spark.createDataFrame([(1998, 5, "<p>")], "year int, month int, html string")
    for _ in range(2):
        downloads.landed(pages, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 and (tmp_path / "raw" / "year=1998").is_dir()


def test_new_files_count_from_the_sessions_own(spark):
    schema = "session_id string, url string, title string, place int, headers map<string,string>, old_path string, agenda_number string, agenda_title string"
    rows = [("1", "u3", None, 0, {}, None, "Ö 1", "Haushalt Berichterstatter: X"), ("1", "u1", "Einladung", 1, {}, None, None, None), ("1", "u2", "Alt", 2, {}, "kept.pdf", None, None), ("2", "u1", "x.pdf", 0, {}, None, None, None)]
    got = {(r.session_id, r.url): r.path for r in downloads.named(spark.createDataFrame(rows, schema)).collect()}
    assert got["1", "u2"] == "kept.pdf"
    assert got["1", "u1"].startswith("session-documents/Einladung-001-") and got["1", "u1"].endswith(".bin")
    assert got["1", "u3"].startswith("agenda/Ö-1-Haushalt/document-002-")
    assert got["2", "u1"].startswith("session-documents/x-pdf-001-") and got["2", "u1"].endswith(".pdf")


def test_store_of_templates(spark, tmp_path):
    path, example = f"file://{tmp_path}/store.json", f"file://{tmp_path}/example.json"
    assert prompts.load(spark, path).count() == 0
    assert json.loads((tmp_path / "store.json").read_text()) == {"templates": []}
    (tmp_path / "example.json").write_text('[{"id": "a", "label": "Ä", "scope": "tops", "prompt_text": "x"}]')
    second = f"file://{tmp_path}/second.json"
    kept = prompts.load(spark, second, example)
    assert [r.label for r in kept.collect()] == ["Ä"]
    prompts.store(prompts.deactivated(kept, "a"), second)
    assert [(r.id, r.is_active, r.scopes) for r in prompts.load(spark, second).collect()] == [("a", False, ["tops"])]
    for bad in ("{", '{"templates": 5}', "7", ""):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            prompts.load(spark, f"file://{tmp_path}/bad.json")


def test_text_is_replaced_whole(spark, tmp_path):
    for content in ("eins\n", "zwei ä\n"):
        sinks.replace_text(spark, f"file://{tmp_path}/x.txt", content)
        assert (tmp_path / "x.txt").read_text() == content
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.txt"]


def test_session_folders(spark):
    paths = ["raw/1998/a/manifest.json", "raw/1998/a/agenda/x/manifest.json", "raw/1998/05/b/agenda/1.pdf", "raw/1998/05/c/note.txt", "raw/1998/05/d/e/manifest.json", "raw/manifest.json", "rawer/1998/f/manifest.json"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert folders.session_folder_count(files, "raw").first().session_folders == 2
    assert folders.session_folder_count(files.limit(0), "raw").first().session_folders == 0


def test_first_page_wins_and_refresh(spark):
    schema = "session_id string, year int, month int, place int, date string, committee string"
    found = spark.createDataFrame([("1", 1998, 2, 0, "1998-01-31", "late"), ("1", 1998, 1, 5, "1998-01-31", "early"), ("2", 1998, 1, 0, None, "known"), (None, 1998, 1, 1, None, "none")], schema)
    known = spark.createDataFrame([("2",), ("2",)], "session_id string")
    rows = lambda **k: {(r.session_id, r.committee, r.month) for r in sessions.online_rows(found, known, **k).collect()}
    assert rows() == {("1", "early", 1)}
    assert rows(refresh_existing=True) == {("1", "early", 1), ("2", "known", None)}
    assert rows(only_refresh=True) == rows(refresh_existing=True, only_refresh=True) == {("2", "known", None)}


def test_document_report_without_answer(spark):
    schema = "job_id int, title string, agenda_item string, document_type string, quality string, chars int, model_name string, response string"
    got = jobs.document_outputs(spark.createDataFrame([(1, None, None, None, None, None, None, None)], schema)).collect()
    assert [(r.output_format, r.content) for r in got] == [("markdown", "# Dokument-Analyse: \n\n- TOP: \n- Typ: \n- Extraktionsqualitaet:  ( Zeichen)\n- Modell: \n\n## KI-Antwort\n\n")]


def test_ids_over_many_ranges(spark):
    """No row is lost or numbered twice where ranges are cut and coalesced anew."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(kept, ("16", "40KB", "false"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(20_000).selectExpr("cast(id % 4001 as string) AS session_id", "id AS place", "repeat('x', 50) AS title")
        got = folders.numbered(rows, "id bigint, session_id string, title string, place bigint", "session_id", "place").orderBy("id").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [r.id for r in got] == list(range(1, 20_001))
    assert [(r.session_id, r.place) for r in got] == sorted((r.session_id, r.place) for r in got)
