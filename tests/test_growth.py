"""What a job does for its input grows no faster than the input: plans and calls, not times."""

import os
import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from ratlas.functions import text as texts
from ratlas.operators import analysis, artifacts, index, postings, sessions, trigrams, vector_index
from ratlas.operators import jobs as job_tables
from ratlas.sources import downloads, folders, html_tables, named_files


def plan(df):
    return df._jdf.queryExecution().toString().partition("Physical Plan")[2]


def test_excerpts_are_not_broadcast(spark, tmp_path):
    spark.range(100).select(F.concat("id", F.lit(".txt")).alias("resolved_path")).write.parquet(f"file://{tmp_path}/d")
    d = spark.read.parquet(f"file://{tmp_path}/d")
    df = analysis.enriched(d, d.select(F.col("resolved_path").alias("path"), F.repeat(F.lit("x"), 20_000).alias("text")))
    assert "Broadcast" not in plan(df) and {len(r.excerpt) for r in df.collect()} == {analysis.EXCERPT}


def test_taken_names_are_tried_once(tmp_path, monkeypatch):
    tried, link = [], os.link
    monkeypatch.setattr(named_files.os, "link", lambda a, b: (tried.append(b), link(a, b)))
    w = named_files.Writer({"path": str(tmp_path)})
    (tmp_path / "a.1.txt").write_text("old")
    os.mkdir(f"{w.staging}/t")
    for i in range(50):
        (tmp_path / w.staging / "t" / str(i)).write_text(str(i))
    w.commit([named_files.Contents(f"{w.staging}/t", ["a.txt"] * 50)])
    assert len(tried) == 51  # one more for the name that was there
    assert (tmp_path / "a.1.txt").read_text() == "old" and (tmp_path / "a.50.txt").read_text() == "49" and len(list(tmp_path.iterdir())) == 51


def test_detail_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("1", "<div class=smc-documents></div>")], "session_id string, html string")
    assert plan(html_tables.session_details(pages, "https://x.example/")[1]).partition("== Optimized")[0].count("MapInArrow") == 1


def test_plain_pages_equal_the_parser():
    bits = ["<table class='x Tagesordnung'>", "</table>", "<TR>", "</tr>", "<td>", "</td>", '<td CLASS="smc-x y" id=q>', "<br>", "<br/>", "<a href='getfile.asp?id=1&amp;b=2'>", "<a href=x/>", "</a>", "a &amp; b", "x", " ", "&uuml;", "<li>", "</ul>", "<p a=1 a=2 checked>", "</p >", "<", "<!-- c -->", "<script>a<b</script>", "&lt", "<a b=>"]
    rnd, plain = random.Random(1), 0

    for _ in range(3000):
        page = "".join(rnd.choice(bits[: rnd.choice([20, len(bits)])]) for _ in range(rnd.randrange(15)))
        parser = html_tables._Tree()
        parser.feed(page)
        parser.close()
        parser._shut(0)
        plain += html_tables._Tree().plain(page)
        shown = [[x if isinstance(x, str) else (x.tag, x.attrs, x.end) for x in items] for items in (html_tables.tree(page).items, parser.items)]
        assert shown[0] == shown[1], page
    assert plain > 1000
    deep = html_tables.tree("<div>" * 20_000 + "x")
    assert deep.text() == "x" and len(deep.all("div")) == 20_000


def test_artifacts_are_read_once(spark):
    files = spark.createDataFrame([("job_1.json", '{"status": "ok"}')], "path string, content string")
    text = plan(artifacts.scan(files))
    assert "get_json_object" not in text and "json_tuple" in text


def test_payloads_join_sessions_once(spark):
    d = spark.createDataFrame([(1, "1", "t", "x", "1", "u", "a.pdf")], "id bigint, session_id string, title string, document_type string, agenda_item string, url string, local_path string")
    s = spark.createDataFrame([("1", "1998-01-01", "Rat", "p")], "session_id string, date string, committee string, session_path string")
    df = vector_index.payloads(d, s, spark.createDataFrame([("p/a.pdf",)], "path string"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftOuter, (session_id") == 2  # for the payload, and for the paths that are looked up
    assert [tuple(r.payload) for r in df.collect()] == [("1", "t", "x", "1", "u", "p/a.pdf", "1998-01-01", "Rat")]


def test_listing_is_brought_to_sessions(spark):
    rnd = random.Random(5)
    folders_ = [None, "", "p", "p/", "p//", "p/q", "p\\q", "p\\", "/p", "/", "a.pdf", "x/y/z/", "ö/é"]
    names = [None, "", "a.pdf", "b/a.pdf", "b\\a.pdf", "/a.pdf", "p/a.pdf", "q/a.pdf", "p\\q\\a.pdf", "é.pdf", "x/y/z/a.pdf", *(f"n{i}" for i in range(150))]
    owns = [(str(i), f, f"d{i}") for i, f in enumerate(folders_)] + [(None, "p", "d"), ("1", "x/y/z", "d")]
    docs = [(i % 300, rnd.choice([*map(str, range(len(folders_) + 2)), None]), rnd.choice(names), f"t{i}") for i in range(1500)]
    paths = ["", "/", "p", "p/", "p/q", "a.pdf", "a.pdf", "p/a.pdf", "p/q/a.pdf", "p//a.pdf", "p//b/a.pdf", "/p/a.pdf", "/a.pdf", "x/y/z", "x/y/z/a.pdf", "x/y/z//a.pdf", "ö/é/é.pdf", "p\\q\\a.pdf", None, *(f"p/n{i}" for i in range(0, 150, 2)), *(f"n{i}" for i in range(0, 150, 7))]
    d = spark.createDataFrame(docs, "id bigint, session_id string, local_path string, title string")
    s = spark.createDataFrame(owns, "session_id string, session_path string, date string")
    f = spark.createDataFrame([(x,) for x in paths], "path string")

    def there(local, folder):
        parts = [x for x in ((folder or "").rstrip("/"), local) if x]
        return any(x and x.replace("\\", "/") in paths for x in (local, "/".join(parts)))

    want = sorted((i, str(t), there(n, p)) for i, k, n, t in docs for p in [x[1] for x in owns if k is not None and x[0] == k] or [None])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = sessions.source_availability(d, s, f, "date")
        assert sorted((r.id, r.title, r.source_available) for r in df.collect()) == want and {x[2] for x in want} == {True, False}
        assert set(df.columns) == {"id", "session_id", "local_path", "title", "session_path", "date", "source_available"}
        none = sessions.source_availability(d, s, f.limit(0))
        assert none.where("source_available").count() == 0 and none.count() == len(want)
        text = vector_index.payloads(d.withColumns({c: F.col("title") for c in ("document_type", "agenda_item", "url")}), s.withColumn("committee", F.col("date")), f)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join \w+, \(id#", text)  # documents aren't put together again by their ids
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_deal_rows_once(spark):
    df = folders.numbered(spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("place")), "id bigint, place bigint", "place")
    assert all(r.id == r.place + 1 for r in df.collect()) and df.count() == 1000
    assert "row_number" not in plan(df)


def test_postings_of_trigrams_read_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).selectExpr("id", "concat('Wind ', id % 7) AS a", "CASE WHEN id % 3 = 0 THEN 'wind 1' WHEN id % 3 = 1 THEN '' END AS b").mapInArrow(counted, "id bigint, a string, b string")
    trigrams.build(rows, ("a", "b"), f"file://{tmp_path}/t", block=8)
    assert seen.value == 300
    held = trigrams.read_dealt(spark, f"file://{tmp_path}/t/holders").collect()
    pairs = [(r.value, i) for r in held for i in r.ids]
    want = {(f"wind {i % 7}", i) for i in range(300)} | {("wind 1", i) for i in range(0, 300, 3)}
    assert len(pairs) == len(want) and set(pairs) == want and all(r.n == len(r.ids) <= 8 for r in held)
    assert {r.id for r in trigrams.candidates(spark, f"file://{tmp_path}/t", ["ind 1", "WIND", "nd 3"]).collect()} == {i for i in range(0, 300, 3) if i % 7 == 3}
    assert {r.id for r in trigrams.candidates(spark, f"file://{tmp_path}/t", ["wind 1"[: i % 6 + 1] + " " * (i // 6) for i in range(6)]).collect()} == {i for i in range(300) if i % 7 == 1 or i % 3 == 0}


def test_trigram_blocks_stay_where_rows_lie(spark, tmp_path, monkeypatch):
    made, write = [], trigrams.write_dealt
    monkeypatch.setattr(trigrams, "write_dealt", lambda df, *a: (made.append(plan(df).partition("== Optimized")[0]), write(df, *a)))
    docs = spark.createDataFrame([(i, str(i % 9), f"Wind {i % 5}", "a" if i % 2 else None) for i in range(90)] + [(90, None, "Wind Rat", None), (91, "x", "Wind 3", "rat")], "id bigint, session_id string, title string, document_type string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("category", "agenda_item", "local_path", "content_type")})
    own = spark.createDataFrame([(str(i), f"2025-01-0{i + 1}", "Rat" if i % 3 else "Haus", "Sitzung") for i in range(9)], "session_id string, date string, committee string, meeting_name string")
    path = f"file://{tmp_path}/t"
    trigrams.index_documents(docs, own, path)
    monkeypatch.undo()
    monkeypatch.setattr(trigrams, "BITS", 2)
    assert len(made) == 6 and not any("Join" in x for x in made) and [x.count("Exchange") for x in made] == [0, 1, 0] * 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in ("rat", "wind 3", "2025-01-0 RAT wind", "haus a", "x rat", "sitz wi ra 2025 5 ind"):
            want = sorted(map(str, sessions.search(docs, own, q).collect()))
            few = trigrams.search(docs, own, q, path)
            with monkeypatch.context() as m:
                m.setattr(trigrams, "MOST_NAMES", 0)
                many = trigrams.search(docs, own, q, path)
            assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) == want and want, q
        text = trigrams.narrowed_documents(docs, path, ["Wind", "RAT"])._jdf.queryExecution().optimizedPlan().toString()
        assert "Contains(lower(coalesce(title" in text and "rat)" not in text  # only what no session holds is asked of documents before they travel
        assert "bucket" in text and text.count("broadcast") == 2  # the blocks of found values alone are read, and none is dealt again
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trigrams_take_further_rows(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame(x, "id bigint, a string")
    trigrams.build(rows((1, "Wind 1"), (None, "Wind 2")), ("a",), path)
    trigrams.build(rows((2, "Wind 1"), (3, "Haus")), ("a",), path, mode="append")
    assert [sorted(r.id for r in trigrams.candidates(spark, path, [t]).collect()) for t in ("wind", "AUS", "u", "wind 2")] == [[1, 2], [3], [3], []]


def test_blocks_of_texts_without_letters_are_empty():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["", None], [], None], pa.list_(pa.string()))], names=["id", "texts"])
    assert sum(b.num_rows for b in trigrams._invert(8)(iter([rows, rows.slice(0, 0)]))) == 0


def test_slugs_are_worked_out_once(spark):
    df = spark.createDataFrame([("Ö 1", "Haushalt - Berichterstatter: X"), (None, ""), ("x" * 300, "y")], "n string, t string")
    df = df.select(texts.agenda_directory(F.col("n"), F.col("t")).alias("d"))
    assert [r.d for r in df.collect()][:2] == ["Ö-1-Haushalt", "document"] and len(df.collect()[2].d) <= 120
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 5


def test_coverage_is_one_grouping(spark):
    a, b = spark.range(10).selectExpr("nullif(id % 7, 6) AS id"), spark.range(4, 12).selectExpr("id")
    df = index.coverage(a, b, "id")
    assert "Join" not in plan(df)
    assert tuple(df.first())[:5] == (6, 8, 2, 4, 6)
    assert tuple(index.coverage(a, None, "id").first()[c] for c in ("current", "indexed", "status")) == (6, 0, "missing_index")


def test_texts_become_postings_in_one_worker(spark, monkeypatch):
    made = []
    monkeypatch.setattr(postings, "write_dealt", lambda df, *a: made.append(df))
    postings.build(spark.createDataFrame([(1, "Rat der rat"), (2, None), (None, "rat")], "id bigint, text string"), "x")
    assert plan(made[0]).partition("== Optimized")[0].count("MapInArrow") == 2  # gathered, then filled up
    assert sorted((tuple(r.ids), r.n) for r in made[0].collect()) == [((1,), 1)] * 2


def test_accents_are_dropped_without_python(spark):
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rows = [("".join(every[i : i + 300]),) for i in range(0, len(every), 300)] + [(None,), ("",), ("abc",)]
    df = spark.createDataFrame(rows, "t string").select("t", texts.without_accents(F.col("t")).alias("a"))
    assert "Python" not in plan(df)
    assert all(r.a == (r.t if r.t is None else unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()) for r in df.collect())


def test_answers_are_read_once(spark):
    answers = [
        '{"title": "T", "article": {"title": "A", "teaser": "i", "body_markdown": "b", "sources": [{"title": "q"}, 1]}}', '{"title": "T", "article": "{\\"title\\": \\"A\\"}", "topic": 1.50}', '{"topic": {"a": [1]}, "article": [{"title": "A"}], "open_questions": ["a", "b"], "sources": null}',
        '{"title": null, "missing_information": "m", "source_notes": [], "contradictions": {"x": true}, "body": "B"}', "[1]", "x", "", None,
    ]
    jobs = spark.createDataFrame([(str(i), a, None, "Rat", "") for i, a in enumerate(answers)], "job_id string, response string, meeting_name string, committee string, error_message string")
    got = {int(r.job_id): r for r in artifacts.structured_outputs(jobs).collect()}
    assert [got[i].topic for i in range(8)] == ["T", "T", '{"a":[1]}', "Rat", "Rat", "Rat", "Rat", "Rat"]
    assert [got[i].open_questions for i in (0, 2, 3)] == [[], ["a", "b"], ["m"]] and got[3].risks == ['{"x":true}']
    df = job_tables.publications(jobs)
    assert {int(r.job_id): (r.title, r.body) for r in df.collect()} == {0: ("A", "b"), 1: ("T", ""), 2: ("Rat", ""), 3: ("Rat", "B")} | {i: ("Rat", "") for i in range(4, 8)}
    assert [r.markdown for r in df.where("job_id = 0").collect()] == ["# A\n\ni\n\nb\n\n## Quellen\n\n1. q"]
    assert artifacts.structured_outputs(jobs)._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 0


def test_manifests_are_dealt_once(spark):
    rows = [("1", f"u{i % 5}", None if i % 2 else "Ö", "t", None) for i in range(20)]
    d = spark.createDataFrame([*rows, ("1", None, None, "t", None)], "session_id string, url string, agenda_item string, title string, category string")
    e = spark.createDataFrame([(*r, f"p{i}", "tag", None, 3, i) for i, r in enumerate([*rows, ("1", None, None, "t", None)])], "session_id string, url string, agenda_item string, title string, category string, path string, etag string, last_modified string, content_length bigint, place int")
    heads = spark.createDataFrame([(f"u{i}", {"etag": "tag" if i else "new"}) for i in range(5)], "url string, headers map<string,string>")
    files = spark.createDataFrame([("1", f"p{i}") for i in range(3)], "session_id string, path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = index.match_manifest(d, e, by=("session_id",))
        assert plan(got).partition("== Optimized")[0].count("Exchange hashpartitioning") == 2
        assert got.where("url IS NULL").first().entry.path == "p20" and got.count() == 21
        df = downloads.planned(d, e, heads, files)
        assert {(r.url, r.agenda_item, r.entry and r.entry.path, r.action) for r in df.collect() if r.entry} == {("u0", "Ö", "p0", "fetch"), ("u1", None, "p1", "reuse"), ("u2", "Ö", "p2", "reuse")}
        narrow = df.select("url", "action")._jdf.queryExecution().optimizedPlan().toString()
        assert "entry#" not in narrow.partition("Join LeftOuter")[0]  # nothing but what is compared is dealt further
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_availability_makes_documents_once(spark):
    d = spark.createDataFrame([(1, "1", "t", "application/pdf", "a.pdf"), (1, "1", "t", "application/pdf", "b.pdf"), (2, "2", None, "text/html", "C\\x.PDF"), (3, "1", "t", "application/pdf", ""), (4, "9", "t", "application/pdf", "x/y.pdf"), (5, "1", "", None, "C\\x.PDF"), (6, "1", "t", None, "a.txt")], "id bigint, session_id string, title string, content_type string, local_path string")
    s = spark.createDataFrame([("1", "p/1/"), ("2", None)], "session_id string, session_path string")
    files = spark.createDataFrame([("p/1/a.pdf",), ("C/x.PDF",), ("x/y.pdf",), ("p/1/a.txt",), ("",), ("3",)], "path string")
    df = sessions.pdf_documents(d, s, files)
    assert len(re.findall(r"Join \w+, \(session_id", df._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert sorted(map(tuple, df.collect())) == [(1, "1", "t", "p/1/a.pdf"), (5, "1", "document-5.pdf", "p/1/C\\x.PDF")]
    assert sorted((r.id, r.local_path, r.source_available) for r in sessions.row_availability(d, s, files).collect()) == [(1, "a.pdf", True), (1, "b.pdf", False), (2, "C\\x.PDF", True), (3, "", False), (4, "x/y.pdf", True), (5, "C\\x.PDF", True), (6, "a.txt", True)]
