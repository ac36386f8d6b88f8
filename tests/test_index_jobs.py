import pytest
from pyspark.sql import functions as F

from ratlas.operators import index, jobs, prompts, vectors
from ratlas.sources.keyed import KeyedTable
from ratlas.streaming import landing


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_not_in_with_null(spark):
    s = spark.createDataFrame([("1",), ("2",)], "session_id string")
    assert rows(index.incomplete(s, spark.createDataFrame([("1",)], "session_id string")), "session_id") == [("2",)]
    assert index.incomplete(s, spark.createDataFrame([("1",), (None,)], "session_id string")).count() == 0


def test_refresh_rules(spark):
    new = spark.createDataFrame([("1",), ("2",), ("3",)], "session_id string")
    known, docs = new.where("session_id < '3'"), new.where("session_id = '1'")
    take = lambda **k: [r[0] for r in rows(index.to_refresh(new, known, docs, **k), "session_id")]
    assert take() == ["2", "3"] and take(refresh_existing=True) == ["1", "2", "3"] and take(only_refresh=True) == ["1", "2"]


def test_upsert_in_steps_equals_one_build(spark):
    schema = "session_id string, v int, place int"
    a, b = spark.createDataFrame([("1", 1, 1), ("2", 2, 1)], schema), spark.createDataFrame([("2", 3, 2), ("2", 4, 3), ("3", 5, 2)], schema)
    none = a.limit(0)
    steps = index.upsert(index.upsert(none, a, "session_id", "place"), b, "session_id", "place")
    assert rows(steps, "session_id", "v") == rows(index.upsert(none, a.union(b), "session_id", "place"), "session_id", "v") == [("1", 1), ("2", 4), ("3", 5)]


def test_backfill(spark):
    df = spark.createDataFrame([("Protokoll öffentlich", "PR", None), ("x", "", "niederschrift"), ("y", "", "vorlage")], "title string, category string, document_type string")
    assert [r.document_type for r in index.backfill_types(df).collect()] == ["protokoll", "protokoll", "vorlage"]


def test_coverage(spark):
    ids = spark.range(3).toDF("id")
    assert tuple(index.coverage(ids, spark.createDataFrame([(1,), (9,)], "id bigint"), "id").first()) == (3, 2, 1, 2, 1, 33.3, "needs_update")
    assert index.coverage(ids, ids, "id").first().status == "ok"
    assert index.coverage(ids.limit(0), ids.limit(0), "id").first().coverage_percent == 100.0
    assert index.coverage(ids, None, "id").first().status == "missing_index"
    assert rows(index.orphans(ids, spark.createDataFrame([(1,), (999999,)], "id bigint"), "id"), "id") == [(999999,)]
    assert rows(index.missing(ids, spark.createDataFrame([(0,)], "id bigint"), "id", 1), "id") == [(1,)]


def test_manifest_match_is_null_safe(spark):
    docs = spark.createDataFrame([("u", None, "t", None)], "url string, agenda_item string, title string, category string")
    entries = spark.createDataFrame([("u", None, "t", None, "p1", 2), ("u", None, "t", None, "p0", 1)], "url string, agenda_item string, title string, category string, path string, place int")
    assert index.match_manifest(docs, entries).first().entry.path == "p0"


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id bigint, dense array<float>")
    assert rows(vectors.cosine(v, [1.0, 1.0]).withColumn("score", F.round("score", 4)), "id", "score") == [(1, 0.7071), (2, 0.7071)]
    d = spark.createDataFrame([(1, "wind wind rat"), (2, "rat"), (3, None)], "id bigint, text string")
    assert [r.id for r in vectors.top(vectors.term_scores(d, ["Wind", "rat"]), 5).collect()] == [1, 2]
    best = vectors.hybrid(v, d, [1.0, 0.0], ["wind"], 2).collect()
    assert best[0].id == 1 and round(best[0].score, 4) == 0.0328
    assert vectors.hybrid(v, d, [1.0, 0.0], ["wind"], 2, F.col("id") == 2).first().id == 2
    sparse = {r.id: r.sparse for r in vectors.sparse_vectors(d).collect()}
    assert len(sparse[1].indices) == 2 and 3 not in sparse
    with pytest.raises(ValueError):
        vectors.pair_vectors(v, vectors.sparse_vectors(d))
    assert len(d.select(vectors.hashing_embedder(8)("text")).first()[0]) == 8


def test_job_merge(spark):
    make = lambda *r: spark.createDataFrame(r, "id bigint, status string, purpose string, created_at string")
    db = jobs.namespaced(make((1, "done", "", "2026-01-02"), (3, "", "", "")), "workflow").unionByName(jobs.namespaced(make((1, "error", "p", "2026-01-01"), (2, "x", "", "")), "local"))
    files = jobs.resolve_files(spark.createDataFrame([(1, "local", "late"), (2, "f", "file"), (7, "f", "own")], "id bigint, source string, purpose string"), db)
    out = jobs.merge(db, files)
    assert rows(out, "job_id", "status", "purpose") == [("7", "", "own"), ("local:1", "error", "p"), ("local:2", "x", "file"), ("workflow:1", "done", ""), ("workflow:3", "", "")]
    assert jobs.find(out, "1").count() == 0 and jobs.find(out, "local:1").count() == 1 and jobs.find(out, "2").first().job_id == "local:2"


def test_outputs_and_publication(spark):
    o = spark.createDataFrame([(2, 1, "markdown", "b"), (1, 1, "markdown", "a"), (3, 1, "json", "{}")], "id bigint, job_id bigint, output_format string, content string")
    assert tuple(jobs.outputs_by_job(o).first()) == (1, ["markdown", "markdown", "json"], "a", "{}")
    r = spark.createDataFrame([(1, '{"title": "T", "intro": "I", "sources": [3, {"title": "S", "url": "u"}]}', "M", "C"), (2, None, None, "C")], "job_id bigint, response string, meeting_name string, committee string")
    got = {x.job_id: x for x in jobs.publications(r).collect()}
    assert got[1].markdown == "# T\n\nI\n\n## Quellen\n\n2. S - u" and got[2].markdown == "# C" and got[1].summary_short == "I"
    j = spark.createDataFrame([(1, "journalistic_publication", "done"), (2, "x", "done")], "job_id bigint, purpose string, status string")
    assert rows(jobs.workflow_outputs(j).groupBy("job_id").count(), "job_id", "count") == [(1, 4), (2, 3)]
    stem = jobs.job_stem(F.lit(1), F.lit("tops"), F.array(F.lit("Ö 7"), F.lit("")), F.lit("m:1"))
    assert spark.range(1).select(stem).first()[0] == "job_1-tops-Oe-7-m-1"


def test_prompts(spark):
    files = spark.createDataFrame([('{"templates": [{"label": "B", "scope": "tops", "is_active": "nein", "revision": "x", "prompt_text": "{{committee}}"}, {"id": "a", "label": "a", "scopes": ["tops", "session"], "is_active": "off"}, 3]}',)], "value string")
    t = prompts.read_templates(files).cache()
    assert [(r.id, r.scopes, r.is_active, r.revision) for r in prompts.listed(t).collect()] == [("a", ["tops", "session"], False, 1), ("b", ["tops"], True, 1)]
    saved = prompts.save(t, t.where("id = 'b'"))
    assert rows(saved, "id", "revision") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="unknown placeholders: fremd"):
        prompts.save(t, t.withColumn("prompt_text", F.lit("{{fremd}}")))
    with pytest.raises(ValueError, match="prompt_text is required"):
        prompts.save(t, t)
    assert rows(prompts.deactivated(t, "b"), "id", "is_active") == [("a", False), ("b", False)]
    q = spark.createDataFrame([(1, "", "tops"), (2, "z", "tops"), (3, "a", "tops"), (4, "b", "x"), (5, "b", "tops")], "request_id int, template_id string, scope string")
    assert rows(prompts.choice_error(q, t), "request_id", "error") == [(1, "none"), (2, "missing"), (3, "inactive"), (4, "wrong_scope"), (5, None)]


def test_stream(spark, tmp_path):
    schema = "session_id string, date string, retrieved_at string"
    land, target, check = f"file://{tmp_path}/land", f"file://{tmp_path}/index", f"file://{tmp_path}/check"
    for batch in ([("1", "a", "t1"), ("2", "b", "t1")], [("2", "c", "t2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        landing.index_stream(spark, land, schema, target, check).awaitTermination()
    assert rows(KeyedTable(spark, target, schema, "session_id").read(), "session_id", "date") == [("1", "a"), ("2", "c")]
