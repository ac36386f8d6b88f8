"""What queries can't show: texts inside values, non-finite vectors, ties, artifacts of a whole run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratlas.functions import jsonx, text
from ratlas.operators import artifacts, index, prompts, sessions, status, vector_index, vectors
from ratlas.sources import pdf_text


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_values_are_not_expanded_again(spark):
    render = lambda t, **v: one(spark, text.render_template(F.lit(t), {k: F.lit(x) for k, x in v.items()}))
    assert render("x {{a}} {{b}}", a="{{b}}", b="B") == "x {{b}} B"
    assert render("{{ a }}{{a}}{{c}}", a="\\1$0", aa="q") == "\\1$0\\1$0{{c}}"
    assert render("{{a}}", a=None) == "" and render("ohne", a="x") == "ohne" and render("") == ""


def test_vectors_that_are_not_finite_have_no_score(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [float("nan"), 1.0]), (4, [1e308, 1e308]), (5, [0.0, 0.0]), (6, None), (7, [1.0])]
    df = spark.createDataFrame(rows, "id int, dense array<double>")
    got = {r.id: r.score for r in vectors.cosine(df, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 4: pytest.approx(0.5**0.5)}
    assert vectors.cosine(df, [0.0, 0.0]).count() == vectors.cosine(df, [float("nan"), 1.0]).count() == 0


def test_terms_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "Der Rat. der rat"), (2, "ratlos"), (3, None), (4, "haus")], "id int, text string")
    scored = vectors.term_scores(docs, ["RAT", "haus", "rat"])
    assert sorted(r.id for r in scored.collect()) == [1, 4]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert vectors.sparse_query(["A", "a", "b"]) == {"a": 1.0, "b": 1.0} and vectors.query_text("x").endswith("Query: x")


def test_upsert_keeps_rows_without_order(spark):
    base = spark.createDataFrame([("1", "alt", "2020")], "id string, v string, at string")
    new = spark.createDataFrame([("1", "neu", None), ("2", "a", None), ("2", "b", None), ("3", "x", "1"), ("3", "y", None)], "id string, v string, at string")
    assert sorted((r.id, r.v) for r in index.upsert(base, new, "id", "at").collect()) == [("1", "neu"), ("2", "b"), ("3", "x")]
    assert index.upsert(base, new, "id").count() == 3


def test_build_deletes_only_without_limit(spark):
    docs, old = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, "old"), (9, "old")], "id int, made string")
    make = lambda df: df.withColumn("made", F.lit("new"))
    build = lambda limit: sorted(tuple(r) for r in vector_index.build(docs, old, make, limit).collect())
    assert build(None) == [(1, "old"), (2, "new"), (3, "new")]
    assert build(1) == [(1, "old"), (2, "new"), (9, "old")] and build(0) == [(1, "old"), (9, "old")]
    assert status.vector_status(spark, docs, old).first().status == "needs_update"


def job(**more):
    row = {"job_id": "7", "context": "# Kontext", "prompt": "Frage", "session_id": "s", "meeting_name": "Rat", "committee": "", "scope": "session", "tops": ["Ö 1"], "source_db": "db", "session_path": "p", "created_at": "2026-01-02T00:00:00Z", "session_date": "2026-01-01", "purpose": "journalistic_publication"}
    return {**row, **more}


def test_a_whole_run(spark):
    schema = "job_id string, context string, prompt string, session_id string, meeting_name string, committee string, scope string, tops array<string>, source_db string, session_path string, created_at string, session_date string, purpose string"
    contexts = spark.createDataFrame([job(), job(job_id="8", context="kaputt")], schema)
    docs = spark.createDataFrame([("7", 2, "B", None, None, "u", "b.pdf", True), ("7", 1, "A", "vorlage", "Ö 1", "u", "a.pdf", None)], "job_id string, id int, title string, document_type string, agenda_item string, url string, local_path string, source_available boolean")

    def provider(prompt, context):
        if context == "kaputt":
            raise RuntimeError("kein Netz")
        return '{"title": "Brücke", "article": {"body_markdown": "Text."}, "open_questions": "wer?"}'

    jobs, files = artifacts.run(contexts, docs, provider, "claude", "m1")
    assert {r.job_id: (r.status, r.error_message) for r in jobs.collect()} == {"7": ("done", ""), "8": ("error", "kein Netz")}
    got = {(r.job_id, r.name): r.content for r in files.collect()}
    assert sorted(n.partition(".")[2] for j, n in got if j == "7") == ["article.md", "ki_response.json", "md", "prompt.txt", "publication.json", "raw.json", "structured.json"]
    assert '"title":"A"' in got["7", "job_7-session-Oe-1-m1.raw.json"].split('"title":"B"')[0]
    assert '"slug":"2026-01-01-bruecke"' in got["7", "job_7-session-Oe-1-m1.publication.json"]
    assert '"risks_or_uncertainties":["kein Netz"]' in got["8", "job_8-session-Oe-1-m1.structured.json"]
    again = artifacts.scan(files.select(F.concat(F.lit("out/"), "name").alias("path"), "content").where("name <> 'latest.md'"))
    assert {r.job_id: (len(r.files), r.warnings) for r in again.collect()} == {"7-session-Oe-1-m1": (6, []), "8-session-Oe-1-m1": (4, [])}


def test_scan_of_broken_and_private_files(spark):
    rows = [("d/job_1.a.json", '{"status": "draft", "session_id": "s", "rendered_prompt_snapshot_path": "x\\\\job_1.snap.txt"}'), ("d/job_1.b.json", '{"status": "done", "markdown": "", "session_id": []}'), ("d/job_1.c.json", "{"), ("d/job_1.md", "Text"), ("x/job_1.snap.txt", "p"), ("data/private/analysis_prompts/job_1.txt", " Frage \n"), ("d/readme.md", "-")]
    r = artifacts.scan(spark.createDataFrame(rows, "path string, content string")).collect()
    assert len(r) == 1 and (r[0].status, r[0].session_id, r[0].markdown, r[0].prompt_text, r[0].has_content) == ("done", "s", "Text", "Frage", True)
    assert r[0].files == ["d/job_1.a.json", "d/job_1.b.json", "d/job_1.c.json", "d/job_1.md"] and r[0].warnings == ["job_1.c.json konnte nicht gelesen werden."]


def test_templates_are_copied(spark):
    t = spark.createDataFrame([("a", "Eins", 4, "public", False)], "id string, label string, revision int, visibility string, is_active boolean")
    assert [tuple(r) for r in prompts.duplicated(t, "a", "b").orderBy("id").collect()][1] == ("b", "Eins (Kopie)", 1, "private", True)
    for bad in (("a", "a"), ("x", "y")):
        with pytest.raises(ValueError):
            prompts.duplicated(t, *bad)


def test_small_values(spark):
    lists = lambda j: one(spark, jsonx.text_list(F.lit(j)))
    assert lists('["a", 1]') == ["a", "1"] and lists("x") == ["x"] and lists(None) == lists("") == lists("[]") == []
    assert one(spark, text.score_text(F.lit(0.01639))) == "0.0164" and one(spark, text.megabytes(F.lit(1572864))) == 1.5
    assert one(spark, jsonx.tops_json(F.lit(None).cast("array<string>"))) == "[]"
    with pytest.raises(KeyError):
        sessions.export_profile("gibt es nicht", None, None, None, dt.date(2026, 1, 1))


def test_pdf_objects_in_strings_and_arrays():
    raw = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R /Note (a endobj 9 0 obj (x\\)) b) >> endobj\n2 0 obj << /Type /Pages /Kids [4 0 R 3 0 R] >> endobj\n"
    raw += b"3 0 obj << /Type /Page /Contents [5 0 R 6 0 R] >> endobj\n4 0 obj << /Type /Page /Contents 7 0 R % Kids [3 0 R]\n >> endobj\n"
    for i, t in ((5, b"drei"), (6, b"vier"), (7, b"eins")):
        raw += b"%d 0 obj << /Length 9 >> stream\nBT (%s) Tj ET\nendstream endobj\n" % (i, t)
    raw += b"trailer << /Root 1 0 R >>"
    assert pdf_text.pdf_pages(raw) == (2, [(1, "eins"), (2, "drei\nvier")])
    for cut in range(0, len(raw), 7):
        pdf_text.pdf_pages(raw[:cut])
    assert pdf_text.pdf_pages(b"") == (0, []) and pdf_text.pdf_pages(b"<<" * 5000 + b"1 0 obj " + b"[" * 5000)[1] == []
