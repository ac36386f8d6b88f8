"""Queries of further operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratlas.functions import dates, jsonx, text, urls
from ratlas.operators import artifacts, index, jobs, messages, sessions, status, vector_index, vectors
from ratlas.plans import tables as t
from ratlas.plans.queries import BOTH, query
from ratlas.plans.tables import AGENDA_SQL, DOCUMENTS_SQL, SESSIONS_SQL, load

_DOCS = f"WITH {DOCUMENTS_SQL}"
_SESSIONS = f"WITH {SESSIONS_SQL}"
_AGENDA = f"WITH {AGENDA_SQL}"


def _files(spark, sf_dir):
    """A listing that has the files of documents with even ids."""
    df = t.documents(spark, sf_dir).where("id % 2 = 0 AND local_path <> ''").join(t.sessions(spark, sf_dir).select("session_id", "session_path"), "session_id")
    return df.select(F.concat_ws("/", "session_path", "local_path").alias("path"))


_THERE = "there AS (SELECT DISTINCT session_id, local_path FROM docs WHERE id % 2 = 0 AND local_path <> '')"


@query(f"{BOTH}, {_THERE} SELECT d.id, d.session_id, coalesce(d.title, '') AS title, coalesce(d.document_type, '') AS document_type, coalesce(d.agenda_item, '') AS agenda_item, coalesce(d.url, '') AS url, CASE WHEN x.session_id IS NULL THEN '' ELSE s.session_path || '/' || d.local_path END AS local_path, s.date, s.committee FROM docs d JOIN sessions s USING (session_id) LEFT JOIN there x ON x.session_id = d.session_id AND x.local_path = d.local_path")
def vector_payloads(spark, sf_dir):
    return vector_index.payloads(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), _files(spark, sf_dir)).select("id", "payload.*")


def _vectors(spark, sf_dir):
    old = t.documents(spark, sf_dir).where("id % 3 <> 0").select("id", F.lit("old").alias("made"))
    return old.distinct().union(load(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.lit("old").alias("made")))


def _made(df):
    return df.select("id", F.lit("new").alias("made")).distinct()


@query(f"{_DOCS} SELECT DISTINCT id, CASE WHEN id % 3 <> 0 THEN 'old' ELSE 'new' END AS made FROM docs")
def vector_build(spark, sf_dir):
    return vector_index.build(t.documents(spark, sf_dir).select("id").distinct(), _vectors(spark, sf_dir), _made)


@query(f"{_DOCS} SELECT DISTINCT id, 'old' AS made FROM docs WHERE id % 3 <> 0 UNION ALL SELECT -1 - n_nationkey, 'old' FROM nation UNION ALL (SELECT DISTINCT id, 'new' FROM docs WHERE id % 3 = 0 ORDER BY id LIMIT 40)")
def vector_build_limited(spark, sf_dir):
    return vector_index.build(t.documents(spark, sf_dir).select("id").distinct(), _vectors(spark, sf_dir), _made, limit=40)


@query(f"{_DOCS} SELECT id, 'old' AS made FROM (SELECT DISTINCT id FROM docs WHERE id % 3 <> 0)")
def vector_delete(spark, sf_dir):
    return vector_index.delete(_vectors(spark, sf_dir), index.orphans(t.documents(spark, sf_dir), _vectors(spark, sf_dir), "id"))


@query(f"""{_DOCS}, d AS (SELECT DISTINCT id FROM docs), n AS (SELECT (SELECT count(*) FROM docs) AS rows, count(*) AS c, count(*) FILTER (id % 3 <> 0) AS k FROM d), v AS (SELECT count(*) AS orphans FROM nation)
SELECT 'none' AS name, NULL::BIGINT AS current, 0::BIGINT AS indexed, NULL::BIGINT AS missing, NULL::BIGINT AS orphaned, NULL::DOUBLE AS coverage_percent, 'missing_local_index' AS status
UNION ALL SELECT 'no documents', NULL, k + orphans, NULL, NULL, NULL, 'missing_local_index' FROM n, v UNION ALL SELECT 'no vectors', rows, 0, NULL, NULL, NULL, 'missing_vectors' FROM n
UNION ALL SELECT 'behind', c, k + orphans, c - k, orphans, round_even(k * 100.0 / c, 1)::DOUBLE, 'needs_update' FROM n, v UNION ALL SELECT 'warned', c, k + orphans, c - k, orphans, round_even(k * 100.0 / c, 1)::DOUBLE, 'warning' FROM n, v
UNION ALL SELECT 'current', c, c, 0, 0, 100.0, 'ok' FROM n""")
def vector_states(spark, sf_dir):
    d, v = t.documents(spark, sf_dir), _vectors(spark, sf_dir)
    cases = {"none": (None, None, False), "no documents": (None, v, False), "no vectors": (d, None, False), "behind": (d, v, False), "warned": (d, v, True), "current": (d, d, False)}
    out = [status.vector_status(spark, a, b, warned=w).withColumn("name", F.lit(name)) for name, (a, b, w) in cases.items()]
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


@query("SELECT true AS local_index_exists, false AS online_index_exists, true AS vectors_exist, true AS raw_data_exists, count(*)::BIGINT AS raw_session_count, count(*) || ' Sitzungsordner' AS raw_data_summary, count(*)::BIGINT AS local_session_count, NULL::BIGINT AS local_document_count, count(*) || ' Sitzungen / 0 Dokumente' AS local_index_summary, NULL::BIGINT AS online_session_count, 'fehlt' AS online_index_summary, 'vorhanden' AS vectors_summary FROM orders")
def status_snapshot(spark, sf_dir):
    s = t.sessions(spark, sf_dir)
    return status.snapshot(spark, s, None, None, s.select("session_path").distinct(), _vectors(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, NULL::BIGINT AS gone, (SELECT count(*) FROM nation)::BIGINT AS nation")
def table_counts(spark, sf_dir):
    return status.table_counts(spark, {"orders": load(spark, sf_dir, "orders"), "gone": None, "nation": load(spark, sf_dir, "nation")})


@query(f"{BOTH}, {_THERE} SELECT d.id, d.session_id, d.title, s.session_path || '/' || d.local_path AS path FROM docs d JOIN sessions s USING (session_id) JOIN there x ON x.session_id = d.session_id AND x.local_path = d.local_path")
def pdf_documents(spark, sf_dir):
    return sessions.pdf_documents(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), _files(spark, sf_dir))


@query("SELECT l_orderkey, string_agg('x/' || l_linenumber || CASE WHEN l_suppkey % 3 = 0 THEN '.txt' ELSE '.PDF' END, '|' ORDER BY l_linenumber) FILTER (l_returnflag = 'N' AND l_suppkey % 3 <> 0) AS paths FROM lineitem GROUP BY 1")
def pdf_paths(spark, sf_dir):
    name = F.concat(F.lit("x/"), F.col("l_linenumber").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, ".txt").otherwise(".PDF"))
    d = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "N").alias("source_available"), name.alias("resolved_path"))))
    df = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(d.alias("d"))
    return df.select("l_orderkey", F.nullif(F.array_join(sessions.pdf_paths(F.col("d")), "|"), F.lit("")).alias("paths"))


@query(f"{_SESSIONS} SELECT session_id, date, committee FROM sessions ORDER BY date DESC NULLS LAST, committee NULLS FIRST, session_id LIMIT 5")
def recent_sessions(spark, sf_dir):
    return sessions.recent(t.sessions(spark, sf_dir)).select("session_id", "date", "committee")


@query("SELECT l_orderkey::VARCHAR AS session_id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey)::BIGINT AS l_partkey FROM lineitem GROUP BY 1")
def first_seen_sessions(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), "l_linenumber", F.col("l_partkey").cast("long").alias("l_partkey"))
    blank = rows.limit(3).withColumn("session_id", F.lit(""))
    return sessions.first_seen(rows.union(blank), "l_linenumber", "l_partkey").select("session_id", "l_partkey")


@query(f"""{BOTH}, b AS (SELECT d.* FROM docs d JOIN sessions USING (session_id) WHERE document_type IN ('vorlage', 'protokoll'))
SELECT '2026-01-02T03:04:05Z' AS generated_at, 'index' AS source_db, '{{"committees": ["a", "b"], "require_path": false}}' AS filters, count(*)::BIGINT AS documents FROM b""")
def export_head(spark, sf_dir):
    b = sessions.export_batch(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), types=("vorlage", "protokoll"))
    return sessions.export_head(b, "2026-01-02T03:04:05Z", "index", committees=("b", "a", "b"), require_path=False)


@query(f"""{BOTH}, b AS (SELECT d.*, s.date FROM docs d JOIN sessions s USING (session_id) WHERE document_type = 'vorlage')
SELECT id, date, (SELECT count(*) FROM b)::BIGINT AS document_count FROM b ORDER BY date, session_id, coalesce(agenda_item, ''), title NULLS FIRST, url NULLS FIRST, id LIMIT 3""")
def export_preview(spark, sf_dir):
    b = sessions.export_batch(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), types=("vorlage",))
    return sessions.export_preview(b).select("id", "date", "document_count")


@query("""SELECT job_id, arg_max(status, path) FILTER (status <> '') AS status, (count(*) FILTER (NOT private))::INT AS files, (count(*) FILTER (bad))::INT AS warnings, true AS has_content
FROM (SELECT (l_orderkey % 40)::VARCHAR AS job_id, CASE WHEN l_suppkey % 7 = 0 THEN 'data/private/' ELSE 'data/out/' END || 'job_' || l_orderkey % 40 || '.' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.json' AS path,
  l_suppkey % 7 = 0 AS private, l_linenumber = 6 AS bad, CASE WHEN l_linenumber = 6 OR l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || l_linenumber END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)) GROUP BY 1""")
def artifact_scan(spark, sf_dir):
    c = lambda x: F.col(x).cast("string")
    job = (F.col("l_orderkey") % 40).cast("string")
    path = F.concat(F.when(F.col("l_suppkey") % 7 == 0, "data/private/").otherwise("data/out/"), F.lit("job_"), job, F.lit("."), F.concat_ws("-", c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey")), F.lit(".json"))
    state = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat("l_returnflag", c("l_linenumber")))
    body = F.when(F.col("l_linenumber") == 6, "{broken").otherwise(F.to_json(F.struct(state.alias("status"), F.lit("text").alias("markdown"), F.lit(9).alias("job_id"))))
    files = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct().select(path.alias("path"), body.alias("content"))
    return artifacts.scan(files).select("job_id", "status", F.size("files").alias("files"), F.size("warnings").alias("warnings"), "has_content")


@query("SELECT o_orderkey::VARCHAR AS job_id, 'json' AS output_format, o_orderstatus AS content, NULL::VARCHAR AS output_type, NULL::VARCHAR AS output_path FROM orders UNION ALL SELECT o_orderkey::VARCHAR, NULL, NULL, 'raw_analysis', o_orderpriority FROM orders")
def output_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    inline = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id"), F.lit("json").alias("output_format"), F.col("o_orderstatus").alias("content"))
    paths = o.select(F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"), F.lit("raw_analysis").alias("output_type"), F.col("o_orderpriority").alias("output_path"))
    return artifacts.output_rows(inline).unionByName(artifacts.output_rows(paths)).unionByName(artifacts.output_rows(o.select("o_orderkey")))


def _jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    answer = F.when(k % 4 == 0, "no json").when(k % 4 == 1, F.concat(F.lit('{"topic": "T'), k.cast("string"), F.lit('", "open_questions": ["a", "b"], "contradictions": "c"}')))
    answer = answer.when(k % 4 == 2, '```json\n{"title": "Titel", "missing_information": "m", "source_notes": []}\n```').otherwise('{"open_questions": null, "source_notes": ["x"]}')
    return load(spark, sf_dir, "orders").select(
        k.cast("string").alias("job_id"), k.cast("string").alias("session_id"), answer.alias("response"), F.lit(None).cast("string").alias("meeting_name"), F.col("o_orderpriority").alias("committee"),
        F.when(k % 3 == 0, "Fehler").otherwise("").alias("error_message"), F.lit("tops").alias("scope"), F.array(F.lit("Ö 1"), F.lit("Ö 2")).alias("tops"), F.lit("index").alias("source_db"), F.lit("").alias("session_path"),
        F.lit("1998-01-02T00:00:00Z").alias("created_at"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("session_date"), F.lit("modell").alias("model_name"), F.lit("journalistic_publication").alias("purpose"),
        F.when(k % 3 == 0, "error").otherwise("done").alias("status"), F.lit("# Kontext").alias("markdown"), F.lit("Frage").alias("prompt"),
    )


@query("""SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 4 = 1 THEN 'T' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'Titel' ELSE o_orderpriority END AS topic,
CASE WHEN o_orderkey % 4 = 1 THEN 'a|b' WHEN o_orderkey % 4 = 2 THEN 'm' ELSE '' END AS open_questions,
array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 1 THEN 'c' WHEN o_orderkey % 4 = 3 THEN 'x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Fehler' END], lambda z: z IS NOT NULL), '|') AS risks FROM orders""")
def structured_outputs(spark, sf_dir):
    return artifacts.structured_outputs(_jobs(spark, sf_dir)).select("job_id", "topic", F.array_join("open_questions", "|").alias("open_questions"), F.array_join("risks", "|").alias("risks"))


@query(f"""{_DOCS} SELECT o_orderkey::VARCHAR AS job_id, '["Ö 1","Ö 2"]' AS tops, count(d.id)::INT AS documents, (count(d.id) FILTER (local_path <> ''))::INT AS available, string_agg(title, '|' ORDER BY id) AS titles FROM orders LEFT JOIN docs d ON session_id = o_orderkey::VARCHAR GROUP BY 1""")
def raw_outputs(spark, sf_dir):
    docs = t.documents(spark, sf_dir).withColumn("job_id", F.col("session_id")).withColumn("source_available", F.col("local_path") != "")
    d = F.from_json(F.get_json_object("value", "$.documents"), "array<struct<title:string,source_available:boolean>>")
    df = artifacts.raw_outputs(_jobs(spark, sf_dir), docs).withColumn("d", d)
    return df.select("job_id", F.get_json_object("value", "$.top_numbers").alias("tops"), F.size("d").alias("documents"), F.size(F.filter("d", lambda x: x["source_available"])).alias("available"), F.nullif(F.array_join("d.title", "|"), F.lit("")).alias("titles"))


@query("""SELECT o_orderkey::VARCHAR AS job_id, substr(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, '1998-01-02') || '-' || CASE WHEN o_orderkey % 4 = 2 THEN 'titel' ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') END, 1, 30) AS slug FROM orders""")
def publication_slugs(spark, sf_dir):
    return artifacts.slugs(_jobs(spark, sf_dir))


@query("""WITH o AS (SELECT *, o_orderkey % 4 AS m, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, '1998-01-02') AS day,
  CASE WHEN o_orderkey % 3 = 0 THEN '["Fehler"]' END AS err FROM orders),
a AS (SELECT *, CASE m WHEN 0 THEN 'no json' WHEN 1 THEN '{"topic": "T' || o_orderkey || '", "open_questions": ["a", "b"], "contradictions": "c"}' WHEN 2 THEN '```json' || chr(10) || '{"title": "Titel", "missing_information": "m", "source_notes": []}' || chr(10) || '```' ELSE '{"open_questions": null, "source_notes": ["x"]}' END AS answer,
  list_filter([CASE m WHEN 1 THEN 'c' WHEN 3 THEN 'x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Fehler' END], lambda z: z IS NOT NULL) AS risks FROM o)
SELECT o_orderkey::VARCHAR AS job_id, (CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 7 END)::BIGINT AS files, 'job_' || o_orderkey || '-tops-Oe-1-Oe-2-modell.article.md' AS first, 'latest.md' AS last,
  '# Kontext' || CASE WHEN m = 0 THEN chr(10) || chr(10) || '## KI-Analyse' || chr(10) || chr(10) || 'no json' || chr(10) ELSE '' END AS article, true AS same_latest, answer, 'Frage' AS prompt,
  '{"job_id":"' || o_orderkey || '","topic":{"title":"' || CASE m WHEN 1 THEN 'T' || o_orderkey WHEN 2 THEN 'Titel' ELSE o_orderpriority END || '"},"open_questions":' || CASE m WHEN 1 THEN '["a","b"]' WHEN 2 THEN '["m"]' ELSE '[]' END || ',"risks_or_uncertainties":[' || coalesce(array_to_string(list_transform(risks, lambda z: '"' || z || '"'), ','), '') || ']}' AS structured,
  CASE WHEN o_orderkey % 3 <> 0 THEN substr(day || '-' || CASE WHEN m = 2 THEN 'titel' ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') END, 1, 30) END AS slug FROM a""")
def artifact_files(spark, sf_dir):
    docs = t.documents(spark, sf_dir).withColumn("job_id", F.col("session_id")).withColumn("source_available", F.col("local_path") != "")
    of = lambda end: F.max(F.when(F.endswith("name", F.lit(end)), F.col("content")))
    df = artifacts.fan_out(_jobs(spark, sf_dir), docs).groupBy("job_id").agg(
        F.count("*").alias("files"), F.min("name").alias("first"), F.max("name").alias("last"), of(".article.md").alias("article"), (of("latest.md") == of(".article.md")).alias("same_latest"),
        F.get_json_object(of(".ki_response.json"), "$.response").alias("answer"), of(".prompt.txt").alias("prompt"), of(".structured.json").alias("structured"), F.get_json_object(of(".publication.json"), "$.slug").alias("slug"),
    )
    return df


@query("SELECT l_orderkey AS job_id, l_linenumber::INT AS at, max(l_returnflag) AS status FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) USING (l_orderkey, l_linenumber) GROUP BY 1, 2")
def job_states(spark, sf_dir):
    events = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("int").alias("at"), F.col("l_returnflag").alias("status"), F.lit("").alias("error_message"))
    return artifacts.current_states(events).select("job_id", "at", "status")


@query("SELECT p_partkey, 'x ' || p_name || ' {{b}} {{ other }} {{b}}' AS text FROM part")
def render_once(spark, sf_dir):
    """Values that hold placeholders themselves stay as they are."""
    return load(spark, sf_dir, "part").select("p_partkey", text.render_template(F.lit("x {{a}} {{ other }} {{ b}}"), {"a": F.concat("p_name", F.lit(" {{b}}")), "b": F.lit("{{b}}")}).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.rtf' WHEN 3 THEN '.pdf' WHEN 4 THEN '.bin' ELSE '.xlsx' END AS extension FROM part")
def document_extensions(spark, sf_dir):
    k = F.col("p_partkey") % 6
    null = F.lit(None).cast("string")
    kind = F.when(k == 0, "Application/PDF; charset=x").otherwise(null)
    disposition = F.when(k == 1, "attachment; filename*=UTF-8''Vor%20lage.DOCX; filename=\"x.pdf\"").when(k == 5, 'inline; filename="plan.xlsx"').otherwise(null)
    url = F.when(k == 2, "https://x.example/a/b.rtf?id=1").otherwise("https://x.example/getfile.asp?id=1")
    return load(spark, sf_dir, "part").select("p_partkey", urls.extension(kind, disposition, url, F.when(k == 3, "Das PDF dazu").otherwise("Titel")).alias("extension"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 0 END AS size, p_partkey % 3 = 0 AS link FROM part")
def header_values(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(k % 4 == 1, F.concat(F.lit("-"), (F.col("p_size") + 1).cast("string"))).when(k % 4 == 2, "viel").otherwise("0")
    href = F.when(k % 6 == 0, "x?TYPE=DO").when(k % 6 == 3, "GetFile.asp?id=1").otherwise("si0057.asp?id=1")
    return load(spark, sf_dir, "part").select("p_partkey", urls.content_length(value).alias("size"), urls.is_document_link(href).alias("link"))


@query(f"{_SESSIONS} SELECT session_id, year, month, '/x/' || session_id AS address FROM sessions")
def months_and_addresses(spark, sf_dir):
    y, m = dates.year_month(F.col("date"))
    return t.sessions(spark, sf_dir).select("session_id", y.alias("year"), m.alias("month"), F.replace(urls.absolute("https://h.example/r/", F.concat(F.lit("/x/"), "session_id")), F.lit("https://h.example"), F.lit("")).alias("address"))


@query("SELECT p_partkey, 'Oe-' || trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS prompt_id, 'Ö-' || p_size || '-' || trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-') AS directory FROM part")
def name_slugs(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return df.select("p_partkey", text.ascii_slug(F.concat(F.lit("Ö "), "p_name"), 300).alias("slug"), text.prompt_id_slug(F.col("p_name")).alias("prompt_id"), text.agenda_directory(F.concat(F.lit("Ö "), F.col("p_size").cast("string")), F.col("p_name")).alias("directory"))


@query(f"{_SESSIONS} SELECT session_id, trim(regexp_replace(committee, '[- ]+', ' ', 'g')) AS committee FROM sessions")
def committees_from_paths(spark, sf_dir):
    return t.sessions(spark, sf_dir).select("session_id", text.committee_from_path(F.col("session_path")).alias("committee"))


@query(f"{_DOCS} SELECT id, CASE WHEN local_path = '' THEN 'metadata_only' ELSE 'pdf_attachment' END AS mode, coalesce(document_type, content_type) AS display_type FROM docs")
def transfer_modes(spark, sf_dir):
    return sessions.detail_type(t.documents(spark, sf_dir)).select("id", jobs.transfer_mode(F.col("local_path")).alias("mode"), "display_type")


@query("SELECT p_partkey, '[\"' || p_brand || '\",\"' || p_size || '\"]' AS names, '# ' || p_name AS body, '[\"' || p_brand || '\"]' AS tops, printf('%.4f', p_size / 60.0) AS score FROM part")
def prompt_scalars(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    names = text.variables(F.concat(F.lit(" "), "p_brand", F.lit(",\n , "), F.col("p_size").cast("string")))
    body = text.without_hint(F.concat(F.lit("# "), "p_name", F.lit("\n## Prompt-Hinweis\nbitte\nkurz")))
    return df.select("p_partkey", F.to_json(names).alias("names"), body.alias("body"), jsonx.tops_json(F.array("p_brand")).alias("tops"), text.score_text(F.col("p_size") / F.lit(60.0)).alias("score"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a|7' WHEN 1 THEN 'wort' WHEN 2 THEN '' WHEN 3 THEN '' ELSE '5' END AS items FROM part")
def text_lists(spark, sf_dir):
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, '["a", 7]').when(k == 1, "wort").when(k == 2, "[]").when(k == 3, F.lit(None)).otherwise("5")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(jsonx.text_list(value), "|").alias("items"))


@query(f"{_AGENDA} SELECT id, number, title FROM agenda WHERE number IN ('Ö 1', 'Ö 4')")
def agenda_in_scope(spark, sf_dir):
    return sessions.agenda_in_scope(t.agenda(spark, sf_dir), "tops", ["Ö 1", "Ö 4"]).select("id", "number", "title")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'e' || l_orderkey END AS etag FROM lineitem")
def manifest_matches(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    key = [F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("url"), F.when(F.col("l_linenumber") % 4 != 0, "Ö 1").alias("agenda_item"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("category")]
    e = d.where("l_linenumber % 2 = 0").select(*key, F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("etag"), F.lit(1).alias("place"))
    e = e.union(e.withColumn("etag", F.lit("later")).withColumn("place", F.lit(2)))
    return index.match_manifest(d.select("*", *key), e).select("l_orderkey", "l_linenumber", "l_partkey", F.col("entry.etag").alias("etag"))


@query("SELECT o_orderkey::VARCHAR AS session_id FROM orders WHERE o_orderkey % 2 = 0")
def refresh_only_known(spark, sf_dir):
    s = t.sessions(spark, sf_dir)
    known = s.where("session_id % 2 = 0")
    docs = t.documents(spark, sf_dir).select("session_id").where("session_id IS NOT NULL")
    return index.to_refresh(s.select("session_id"), known.select("session_id"), docs, only_refresh=True).select("session_id")


@query("SELECT o_custkey AS id, max(o_orderkey)::BIGINT AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_ties(spark, sf_dir):
    """New rows without an order, or of equal order, of which the largest stays."""
    base = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(-1).cast("long").alias("v"), F.lit(None).cast("string").alias("at"))
    new = load(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").cast("long").alias("id"), F.col("o_orderkey").cast("long").alias("v"), F.lit(None).cast("string").alias("at"))
    return index.upsert(base, new, "id", "at").select("id", "v")


@query("SELECT vec_id AS id, 1 AS weight FROM embeddings")
def paired_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    dense = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    both = vectors.pair_vectors(dense, e.select(F.col("vec_id").alias("id"), F.lit(1).alias("sparse")))
    return both.select("id", F.col("sparse").alias("weight"))


@query(f"{_SESSIONS} SELECT session_id, CASE WHEN date IS NULL THEN 'Datum unbekannt' WHEN date < '1996-06-01' THEN 'vergangene Sitzung' WHEN date = '1996-06-01' THEN 'heutige Sitzung' ELSE 'zukünftige Sitzung' END AS state, date || 'T00:00:00Z' AS stamp FROM sessions")
def session_words(spark, sf_dir):
    return t.sessions(spark, sf_dir).select("session_id", dates.session_state(F.col("date"), "1996-06-01").alias("state"), dates.utc_text(F.col("date").cast("date").cast("timestamp_ntz")).alias("stamp"))


@query(f"""{BOTH} SELECT d.id, s.date FROM docs d JOIN sessions s USING (session_id) WHERE s.date BETWEEN '1997-01-01' AND '1997-12-31' AND document_type = 'protokoll' AND local_path <> ''""")
def export_profile(spark, sf_dir):
    import datetime as dt

    out = sessions.export_profile("Nur Protokolle", t.documents(spark, sf_dir), t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), dt.date(1997, 5, 6))
    return out.select("id", "date")


@query(f"{_SESSIONS}, x AS (SELECT session_id, detail_url, CASE year % 3 WHEN 0 THEN '' WHEN 1 THEN committee END AS c, CASE WHEN month % 2 = 0 THEN meeting_name ELSE '' END AS m FROM sessions) SELECT session_id, detail_url, coalesce(nullif(c, ''), nullif(m, ''), 'Sitzung') AS committee, coalesce(nullif(m, ''), nullif(c, ''), 'Sitzung') AS meeting_name FROM x")
def session_references(spark, sf_dir):
    m = F.col("year") % 3
    s = t.sessions(spark, sf_dir).withColumns({"committee": F.when(m == 0, "").when(m == 1, F.col("committee")), "meeting_name": F.when(F.col("month") % 2 == 0, F.col("meeting_name")).otherwise("")})
    return sessions.references(s).select("session_id", "detail_url", "committee", "meeting_name")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS c, 'Frage ' || o_orderkey AS p, o_orderkey % 3 AS m FROM orders),
n AS (SELECT *, chr(10) || chr(10) AS nn FROM o)
SELECT o_orderkey, '## Analysegrundlage' || nn || c || nn || '## Analyseauftrag' || nn || p AS plain,
  'Du analysierst kommunalpolitische Dokumente. Antworte auf Deutsch.' || nn || '## Analysegrundlage' || nn || c || CASE m WHEN 0 THEN '' ELSE nn || '### PDF: a.pdf' || nn || CASE m WHEN 1 THEN 'Text' ELSE '[Text nicht extrahierbar]' END END || nn || '## Analyseauftrag' || nn || p AS with_text,
  CASE m WHEN 1 THEN '[{"type":"text","text":"## Analysegrundlage\\n\\n' || c || '"},{"type":"document","source":{"type":"base64","media_type":"application/pdf","data":"' || to_base64(encode(c)) || '"}},{"type":"text","text":"## Analyseauftrag\\n\\n' || p || '"}]'
         WHEN 2 THEN '[{"type":"text","text":"## Analysegrundlage\\n\\n' || c || '"},{"type":"text","text":"[PDF nicht lesbar: a.pdf]"},{"type":"text","text":"## Analyseauftrag\\n\\n' || p || '"}]' END AS blocks FROM n""")
def provider_messages(spark, sf_dir):
    m, context, prompt = F.col("o_orderkey") % 3, F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), F.concat(F.lit("Frage "), F.col("o_orderkey").cast("string"))
    pdf = F.struct(F.lit("a.pdf").alias("name"), F.when(m == 1, "Text").alias("text"), F.when(m == 1, context).cast("binary").alias("content"))
    pdfs = F.when(m > 0, F.array(pdf)).otherwise(F.slice(F.array(pdf), 1, 0))
    return load(spark, sf_dir, "orders").select("o_orderkey", messages.user_message("codex", prompt, context).alias("plain"), messages.user_message("ollama", prompt, messages.with_pdf_text(context, pdfs)).alias("with_text"), messages.content_blocks("claude", prompt, context, pdfs).alias("blocks"))


@query(f"{_DOCS} SELECT id, CASE WHEN id % 4 = 0 THEN 'protokoll' WHEN coalesce(CASE WHEN id % 3 > 0 THEN document_type END, '') <> '' THEN document_type WHEN contains(lower(coalesce(title, '') || ' ' || coalesce(category, '')), 'protokoll') THEN 'protokoll' ELSE 'sonstiges' END AS document_type FROM docs")
def backfilled_types(spark, sf_dir):
    """Blank types are inferred, the older name is replaced, others stay."""
    i = F.col("id")
    d = t.documents(spark, sf_dir).withColumn("document_type", F.when(i % 4 == 0, " Niederschrift").when(i % 3 > 0, F.col("document_type"))).drop("local_path")
    return index.backfill_types(d).select("id", "document_type")


@query("SELECT doc_id, sha256(replace(coalesce(text, ''), chr(10) || '## Prompt', ' ') || chr(10) || 'Ende') AS kept FROM documents")
def hint_removed(spark, sf_dir):
    body = F.replace(text.as_text(F.col("text")), F.lit("\n## Prompt"), F.lit(" "))
    whole = F.concat(body, F.lit("\nEnde\n## Prompt-Hinweis\n"), text.as_text(F.col("text")))
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.without_hint(whole), 256).alias("kept"))
