import pytest
from pyspark.sql import functions as F

from ratlas import __main__ as cli
from ratlas.functions import paths
from ratlas.operators import analysis, messages, sessions
from ratlas.sources import folders, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_paths(spark):
    got = lambda s, p: one(spark, paths.candidates(F.lit(s), F.lit(p)))
    new = "data/raw/2026/03/2026-03-01-Rat-7"
    assert got(new, "agenda\\a.pdf") == [f"{new}/agenda/a.pdf"]
    assert got("data/raw/2026/2026-03-01-Rat-7", "a.pdf") == ["data/raw/2026/2026-03-01-Rat-7/a.pdf", f"{new}/a.pdf"]
    assert got(new, "../../../../../etc/passwd") == [] and got(new, "/etc/passwd") == [] and got(None, "a.pdf") == [] and got(new, " ") == []
    assert got("/srv/data/raw/2026/03/x", "/srv/data/raw/y.pdf") == ["/srv/data/raw/y.pdf"]
    assert one(spark, paths.output_folder(F.lit("data\\raw\\2026\\03\\f"), F.lit("d"), F.lit("c"), F.lit("7"))) == "2026/03/f"
    assert one(spark, paths.output_folder(F.lit(""), F.lit(None).cast("string"), F.lit("2026-04-05T1"), F.lit("7"))) == "2026/04/2026-04-05-7"


def test_context(spark):
    row = "named_struct('date', '2026-03-01', 'committee', 'Rat', 'meeting_name', '')"
    agenda = "array(named_struct('number', 'Ö 1', 'title', 'Haushalt', 'status', null, 'decision', null), named_struct('number', 'Ö 2', 'title', 'x', 'status', 's', 'decision', 'd'))"
    docs = "array(named_struct('agenda_item', 'Ö 1', 'document_type', null, 'title', 'T', 'source_available', true, 'transfer_mode', 'text_excerpt', 'resolved_path', 'p', 'url', null, 'excerpt', 'a\\nb'))"
    text = one(spark, analysis.context_markdown(F.expr(row), F.expr(agenda), F.expr(docs), "tops", ["Ö 1"], F.lit(""), "2026-03-02"))
    assert "- Sitzung: vergangene Sitzung" in text and "- Ö 1: Haushalt\n  - Status: -" in text and "Ö 2" not in text
    assert "- Ö 1 | unbekannt | T | lokale Quelle: ja | KI-Übergabe: text_excerpt\n  - pfad: p\n  - url: -\n  - Textauszug:\n    a\n    b" in text
    assert text.endswith("## Prompt-Hinweis\n(kein Prompt gesetzt)")


def test_answers_and_articles(spark):
    df = spark.createDataFrame([(1, "K\n## Prompt-Hinweis\nP", "P"), (2, "bad", "P")], "job_id bigint, context string, prompt string")

    def provider(prompt, context):
        if context == "bad":
            raise ValueError("kaputt")
        return f"{prompt}:{context}"

    got = {r.job_id: (r.response, r.status, r.error_message) for r in analysis.answered(df, provider, "ollama").collect()}
    assert got == {1: ("P:K", "done", ""), 2: ("", "error", "kaputt")}
    assert {r.status for r in analysis.answered(df, None).collect()} == {"draft"}
    jobs = spark.createDataFrame(
        [(1, "M", '{"title": "T", "body": "B"}', "journalistic_publication", "session"), (2, "M", "A", "content_analysis", "session"), (3, "M", "A", "content_analysis", "document"), (4, "M", "{}", "journalistic_publication", "session")],
        "job_id bigint, markdown string, response string, purpose string, scope string",
    ).withColumns({"meeting_name": F.lit(""), "committee": F.lit("")})
    assert {r.job_id: r.article for r in analysis.articles(jobs).collect()} == {1: "# T\n\nB", 2: "M\n\n## KI-Analyse\n\nA\n", 3: "M", 4: "M\n\n## KI-Analyse\n\n{}\n"}


def test_requests(spark):
    s = spark.createDataFrame([("1",)], "session_id string")
    usable = spark.createDataFrame([("1", "Ö 1")], "session_id string, number string")
    assert analysis.problems(analysis.Request("1"), s, usable) == []
    assert analysis.problems(analysis.Request("2", "tops", ("Ö 1", "Ö 9"), "x", "y"), s, usable) == ["unknown session", "no documents for Ö 1", "no documents for Ö 9", "unknown provider", "unknown purpose"]
    assert analysis.problems(analysis.Request("1", "tops"), s, usable) == ["no agenda item chosen"]


def test_enriched(spark):
    d = spark.createDataFrame([("a.txt",), ("b.pdf",), ("c.txt",), (None,)], "resolved_path string")
    f = spark.createDataFrame([("a.txt", " text "), ("b.pdf", "x")], "path string, text string")
    got = {r.resolved_path: (r.source_available, r.transfer_mode, r.excerpt) for r in analysis.enriched(d, f).collect()}
    assert got == {"a.txt": (True, "text_excerpt", "text"), "b.pdf": (True, "pdf_attachment", ""), "c.txt": (False, "metadata_only", ""), None: (False, "metadata_only", "")}


def test_sinks(spark, tmp_path):
    p = f"file://{tmp_path}/job_1.article.md"
    assert [sinks.write_text(spark, p, t).rpartition("/")[2] for t in ("a\n\n", "b")] == ["job_1.article.md", "job_1.article.1.md"]
    assert (tmp_path / "job_1.article.md").read_text() == "a\n" and (tmp_path / "job_1.article.1.md").read_text() == "b\n"


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "raw/2026/03/2026-03-01-Rat-7"
    d.mkdir(parents=True)
    (d / "manifest.json").write_text('{"session": {"meeting_name": "Sitzung"}, "retrieved_at": "t", "documents": [{"title": "Protokoll", "url": "u", "agenda_item": "Ö 1"}]}')
    (d / "agenda_summary.json").write_text('{"agenda_items": [{"number": "Ö 1", "title": "Haushalt"}]}')
    at = lambda n: f"file://{tmp_path}/{n}"
    for old, new in (("none", "one"), ("one", "two")):  # a second build of the same folders changes nothing
        assert cli.main(["--index", at(old), "build", "--raw", at("raw"), "--target", at(new)]) == 0
    tables = cli.read(spark, at("two"))
    assert [t.count() for t in tables] == [1, 1, 1]
    assert cli.main(["--index", at("two"), "search", "protokoll rat"]) == 0 and "Protokoll" in capsys.readouterr().out
    assert cli.main(["--index", at("two"), "show", "7"]) == 0 and "Haushalt" in capsys.readouterr().out
    assert cli.main(["--index", at("two"), "show", "8"]) == 1 and cli.main(["--index", at("two"), "list"]) == 0
    assert cli.main(["--index", at("two"), "export", "--out", at("out")]) == 0
    assert cli.main(["--index", at("two"), "coverage", "--stored", at("none")]) == 0 and "needs_update" in capsys.readouterr().out
    assert cli.main(["--index", at("two"), "vectors", "--stored", at("none"), "--target", at("v1"), "--limit", "1"]) == 0
    assert spark.read.parquet(at("v1")).count() == 1
    assert cli.main(["--index", at("two"), "vectors", "--stored", at("v1"), "--target", at("v2")]) == 0
    assert cli.main(["--index", at("two"), "coverage", "--stored", at("v2")]) == 0 and "|100.0" in capsys.readouterr().out
    page = "<table id=smc_page_si0040_contenttable1><tr><td><span class=weekday>9.</span><td class=silink><a class=smc-link-normal href='si0057.asp?__ksinr=77'>Hafenrunde</a></table>"
    spark.createDataFrame([(1, 2020, 3, page), (2, 2020, 4, page)], "page_id bigint, year int, month int, html string").write.parquet(at("pages"))
    assert cli.main(["--index", at("two"), "online", "--pages", at("pages"), "--target", at("three"), "--base", "https://x.example/"]) == 0
    assert {r.session_id: r.date for r in spark.read.parquet(at("three/sessions")).collect()}["77"] == "2020-03-09"
    assert '"top_title":"Haushalt"' in spark.read.text(at("out")).first()[0]
    summary = sinks.agenda_summaries(tables[0], tables[1], "t").first().value
    assert '"agenda_items":[{"number":"Ö 1","title":"Haushalt"' in summary
    assert '"documents":[{"url":"u"' in sinks.manifests(tables[0].withColumn("retrieved_at", F.lit("t")), tables[2]).first().value


def test_providers_by_name():
    ask = lambda prompt, context: "a"
    assert messages.provider("codex", {"codex": ask}) is ask and set(messages.PROVIDER_LABELS) == set(analysis.PROVIDERS)
    for name, what in (("none", "no provider"), ("neu", "unknown provider 'neu'"), ("ollama", "not set up")):
        with pytest.raises(ValueError, match=what):
            messages.provider(name, {"codex": ask})


def test_contexts_are_cut_for_the_provider(spark):
    df = spark.createDataFrame([("x" * 30_000, None)], "c string, p string")
    row = df.select(messages.user_message("ollama", F.col("p"), F.col("c")).alias("a"), messages.user_message("codex", F.col("p"), F.col("c")).alias("b")).first()
    assert row.a.count("x") == 24_000 and row.b.count("x") == 30_000 and row.b.endswith("## Analyseauftrag\n\n")


def test_lookup_of_a_session(spark, tmp_path):
    schema = "session_id string, committee string, meeting_name string, detail_url string"
    df = spark.createDataFrame([("k4", "", "Hafenrunde", "u"), ("k5", "", None, "u"), ("k6", "Beirat", "", "")], schema)
    assert tuple(sessions.reference(df, "k4"))[:3] == ("k4", "Hafenrunde", "Hafenrunde") and sessions.reference(df, "k5").committee == "Sitzung"
    for key, what in (("k7", "not in the index"), ("k6", "no detail_url")):
        with pytest.raises(LookupError, match=what):
            sessions.reference(df, key)
    with pytest.raises(FileNotFoundError):
        folders.stored(spark, f"file://{tmp_path}/none", schema)
    (tmp_path / "broken.parquet").write_bytes(b"no table")
    with pytest.raises(ValueError, match="no readable index"):
        folders.stored(spark, f"file://{tmp_path}/broken.parquet", schema)
    df.drop("detail_url").write.parquet(f"file://{tmp_path}/part")
    with pytest.raises(ValueError, match="lacks detail_url"):
        folders.stored(spark, f"file://{tmp_path}/part", schema)
    df.write.parquet(f"file://{tmp_path}/whole")
    assert folders.stored(spark, f"file://{tmp_path}/whole", schema).count() == 3
