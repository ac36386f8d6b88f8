"""Queries of sources, downloads, prompts and jobs over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratlas.functions import text
from ratlas.operators import analysis, jobs, prompts, sessions
from ratlas.plans import tables as t
from ratlas.plans.queries import BOTH, query
from ratlas.plans.tables import DOCUMENTS_SQL, SESSIONS_SQL, load
from ratlas.schemas import DOCUMENTS
from ratlas.sources import downloads, folders, html_tables, pdf_text

_DOCS = f"WITH {DOCUMENTS_SQL}"
_SESSIONS = f"WITH {SESSIONS_SQL}"
_HEADERS = "map<string,string>"


def _c(name: str) -> F.Column:
    return F.col(name).cast("string")


@query("""SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, printf('month=%02d,year=%d,__cjahr=%d,__cmonat=%02d,__cmandant=2,__canz=1,__cselect=0', month(o_orderdate), year(o_orderdate), year(o_orderdate), month(o_orderdate)) AS params FROM orders""")
def month_requests(spark, sf_dir):
    months = t.sessions(spark, sf_dir).select("year", "month").distinct()
    pairs = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return downloads.month_requests(months).select("year", "month", F.array_join(pairs, ",").alias("params"))


def _fetch(url: str) -> downloads.Answer:
    """What stands for a portal: the address is the document, and its number says what goes wrong."""
    n = int(url.rpartition("/")[2])
    if n % 7 == 0:
        raise OSError(f"no answer {n}")
    if n % 7 == 1:
        return b"", {"Content-Length": "5000"}
    return (url * (200 if n % 7 == 2 else 1)).encode(), {"ETag": f"e{n}", "Content-Type": "application/pdf"}


@query("""WITH u AS (SELECT DISTINCT s_nationkey AS n, 'https://x.example/' || s_nationkey AS url FROM supplier)
SELECT url, CASE WHEN n % 7 > 2 THEN sha1(url) END AS sha1, CASE WHEN n % 7 > 1 THEN 'e' || n END AS etag, CASE n % 7 WHEN 0 THEN 'no answer ' || n WHEN 1 THEN 'document exceeds size limit (5000 > 1000 bytes)' WHEN 2 THEN 'document exceeds size limit (' || 200 * length(url) || ' > 1000 bytes)' END AS error FROM u""")
def downloads_fetched(spark, sf_dir):
    asked = load(spark, sf_dir, "supplier").select(F.concat(F.lit("https://x.example/"), _c("s_nationkey")).alias("url"))
    out = downloads.fetched(asked.union(asked.limit(1).select(F.lit("").alias("url"))), _fetch, most=1000)
    return out.select("url", F.sha1("content").alias("sha1"), F.try_element_at("headers", F.lit("etag")).alias("etag"), "error")


@query("SELECT DISTINCT 'https://x.example/' || s_nationkey AS url, CASE WHEN s_nationkey % 7 = 0 THEN 0 WHEN s_nationkey % 7 = 1 THEN 1 ELSE 2 END AS headers FROM supplier")
def downloads_probed(spark, sf_dir):
    asked = load(spark, sf_dir, "supplier").select(F.concat(F.lit("https://x.example/"), _c("s_nationkey")).alias("url"))
    return downloads.probed(asked, lambda url: _fetch(url)[1]).select("url", F.size("headers").alias("headers"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 3 <> 0 AND CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE false END THEN 'reuse' ELSE 'fetch' END AS action FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def downloads_planned(spark, sf_dir):
    """Entries of even suppliers, files of parts that three doesn't divide; headers by the part: the same tag, another tag,
    the same date, the same date with another length, none."""
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    own = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    null = F.lit(None).cast("string")
    docs = d.select("*", _c("l_orderkey").alias("session_id"), own.alias("url"), null.alias("agenda_item"), F.lit("t").alias("title"), null.alias("category"))
    k = F.col("l_partkey") % 5
    entry = [F.concat(F.lit("p/"), "url").alias("path"), F.when(k < 2, "tag").alias("etag"), F.lit("monday").alias("last_modified"), F.lit(7).cast("long").alias("content_length"), F.lit(1).alias("place")]
    keys = ["session_id", "url", "agenda_item", "title", "category"]
    entries = docs.where("l_suppkey % 2 = 0").select(*keys, *entry)
    others = entries.withColumns({"session_id": F.lit("other"), "path": F.lit("elsewhere"), "place": F.lit(0)})
    files = docs.where("l_partkey % 3 <> 0").select("session_id", F.concat(F.lit("p/"), "url").alias("path"))
    answer = F.when(k == 0, F.create_map(F.lit("etag"), F.lit(" tag "))).when(k == 1, F.create_map(F.lit("etag"), F.lit("new"), F.lit("last-modified"), F.lit("monday")))
    answer = answer.when(k == 2, F.create_map(F.lit("last-modified"), F.lit("monday"))).when(k == 3, F.create_map(F.lit("last-modified"), F.lit("monday"), F.lit("content-length"), F.lit("8")))
    heads = docs.select("url", answer.otherwise(F.expr(f"cast(map() as {_HEADERS})")).alias("headers"))
    return downloads.planned(docs, entries.unionByName(others), heads, files).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "action")


_STORED = f"""{_DOCS}, n AS (SELECT *, id % 3 = 0 AS old, sum((id % 3 <> 0)::INT) OVER (PARTITION BY session_id ORDER BY agenda_item IS NOT NULL, id, url) AS i FROM docs),
p AS (SELECT id, session_id, url, CASE WHEN old THEN 'old/' || id ELSE CASE WHEN agenda_item IS NULL THEN 'session-documents' ELSE 'agenda/Ö-' || substr(agenda_item, 3) || '-Haushalt' END || '/' || replace(title, ' ', '-') || '-' || lpad(i::VARCHAR, 3, '0') || '-' || sha1(url)[1:8] || '.pdf' END AS path FROM n)"""


def _stored(spark, sf_dir):
    headers = F.create_map(F.lit("content-type"), F.lit("application/pdf"), F.lit("content-length"), F.when(F.col("id") % 2 == 0, "0").otherwise(" 12"))
    d = t.documents(spark, sf_dir).withColumns({"place": F.col("id"), "headers": headers, "agenda_number": F.col("agenda_item"), "agenda_title": F.when(F.col("agenda_item").isNotNull(), "Haushalt")})
    return downloads.named(d.withColumn("old_path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("old/"), _c("id")))))


@query(f"{_STORED} SELECT id, path FROM p")
def document_paths(spark, sf_dir):
    return _stored(spark, sf_dir).select("id", "path")


@query(f"{_STORED} SELECT session_id, url, path, sha1(url) AS sha1, CASE WHEN id % 2 = 0 THEN strlen(url) ELSE 12 END::BIGINT AS content_length, 'application/pdf' AS content_type, NULL::VARCHAR AS etag FROM p")
def manifest_entries(spark, sf_dir):
    return downloads.entries(_stored(spark, sf_dir).withColumn("content", F.col("url").cast("binary"))).select("session_id", "url", "path", "sha1", "content_length", "content_type", "etag")


@query("""SELECT l_orderkey::VARCHAR AS session_id, 'Rat ' || l_linenumber AS committee, '1998-02-0' || l_linenumber AS date, 1998 AS year, 2 AS month, NULL::VARCHAR AS session_path FROM (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) WHERE l_orderkey % 2 = 1""")
def online_new_sessions(spark, sf_dir):
    return sessions.online_rows(_found(spark, sf_dir), _known(spark, sf_dir)).select("session_id", "committee", "date", "year", "month", "session_path")


@query("SELECT DISTINCT l_orderkey::VARCHAR AS session_id FROM lineitem")
def online_all_sessions(spark, sf_dir):
    return sessions.online_rows(_found(spark, sf_dir), _known(spark, sf_dir), refresh_existing=True).select("session_id")


@query("SELECT DISTINCT l_orderkey::VARCHAR AS session_id FROM lineitem WHERE l_orderkey % 2 = 0")
def online_known_sessions(spark, sf_dir):
    return sessions.online_rows(_found(spark, sf_dir), _known(spark, sf_dir), only_refresh=True).select("session_id")


def _known(spark, sf_dir):
    return t.sessions(spark, sf_dir).where("session_id % 2 = 0").select("session_id")


def _found(spark, sf_dir):
    n = _c("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(
        _c("l_orderkey").alias("session_id"), F.lit(1998).alias("year"), F.col("l_linenumber").alias("month"), F.lit(0).alias("place"), F.concat(F.lit("Rat "), n).alias("committee"), F.concat(F.lit("1998-02-0"), n).alias("date"),
    )


@query(f"{BOTH}, x AS (SELECT DISTINCT session_id, local_path FROM docs WHERE id % 2 = 0 AND local_path <> '') SELECT s.session_id, count(d.id) AS document_count, count(x.session_id) AS available_count, count(d.id) - count(x.session_id) AS missing_count FROM sessions s LEFT JOIN docs d USING (session_id) LEFT JOIN x ON x.session_id = d.session_id AND x.local_path = d.local_path GROUP BY 1")
def availability_counts(spark, sf_dir):
    d, s = t.documents(spark, sf_dir), t.sessions(spark, sf_dir)
    files = d.where("id % 2 = 0 AND local_path <> ''").join(s.select("session_id", "session_path"), "session_id").select(F.concat_ws("/", "session_path", "local_path").alias("path"))
    return sessions.availability_counts(d, s, files)


@query(f"{_DOCS}, one AS (SELECT min(id) AS id FROM docs) SELECT id, session_id, title FROM docs WHERE id = (SELECT id FROM one)")
def session_document(spark, sf_dir):
    d = t.documents(spark, sf_dir)
    one = d.orderBy("id", "session_id").select("id", "session_id").first()
    own = sessions.session_document(d, one.session_id, one.id)
    return own.unionByName(sessions.session_document(d, "other", one.id)).select("id", "session_id", "title")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 4 < 3)::BIGINT AS session_folders")
def session_folder_count(spark, sf_dir):
    k, at = F.col("o_orderkey") % 4, F.concat(F.lit("raw/1998/"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("05/"), _c("o_orderkey"))
    name = F.when(k == 0, "/manifest.json").when(k == 1, "/agenda/TOP-1/x.pdf").when(k == 2, "/session-documents/y.pdf").otherwise("/notes.txt")
    files = load(spark, sf_dir, "orders").select(F.explode(F.array(F.concat(at, name), F.concat(at, F.lit("/z.txt")), F.concat(F.lit("other/1998/"), _c("o_orderkey"), F.lit("/manifest.json")))).alias("path"))
    return folders.session_folder_count(files, "raw")


@query("SELECT count(*)::BIGINT AS files, count(DISTINCT l_orderkey)::BIGINT AS folders, sum(l_partkey)::BIGINT AS bytes, round(sum(l_partkey) / 1048576.0::DOUBLE, 6) AS megabytes FROM lineitem")
def inventory_sums(spark, sf_dir):
    files = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("raw/"), _c("l_orderkey"), F.lit("/"), _c("l_linenumber")).alias("path"), F.col("l_partkey").alias("length"))
    return folders.inventory(files).select("files", "folders", F.col("bytes").cast("long").alias("bytes"), F.round(F.col("bytes") / F.lit(1048576.0), 6).alias("megabytes"))


def _folders(spark, sf_dir):
    """A folder for each session with its manifest and summary; every fifth manifest is broken."""
    d = t.documents(spark, sf_dir).select("session_id", F.struct("id", "title", "category", "agenda_item", "url", F.col("local_path").alias("path"), "content_type").alias("d"))
    docs = d.groupBy("session_id").agg(F.array_sort(F.collect_list("d")).alias("documents"))
    s = t.sessions(spark, sf_dir).join(docs, "session_id", "left").withColumn("documents", F.coalesce("documents", F.expr("array()")))
    body = F.to_json(F.struct(F.struct("meeting_name", "detail_url").alias("session"), F.lit("1998-01-01T00:00:00Z").alias("retrieved_at"), "documents"))
    items = F.concat(F.lit('{"agenda_items": [{"number": "1", "title": "A", "documents_present": true}, 7, {"number": "2", "title": "'), "committee", F.lit('", "decision": "accepted"}]}'))
    manifest = F.when(F.col("session_id") % 5 == 0, "{broken").otherwise(body)
    return s.select(F.col("session_path").alias("folder"), "date", "committee", "session_id", manifest.alias("manifest"), F.when(F.col("session_id") % 7 != 0, items).alias("agenda_summary"))


@query(f"{_SESSIONS} SELECT session_id, date, year, month, committee, CASE WHEN session_id::BIGINT % 5 <> 0 THEN meeting_name END AS meeting_name, session_path FROM sessions")
def local_index_sessions(spark, sf_dir):
    return folders.local_index(_folders(spark, sf_dir))[0].select("session_id", "date", "year", "month", "committee", "meeting_name", "session_path")


@query(f"{_SESSIONS} SELECT session_id, '1' AS number, 'A' AS title, NULL::VARCHAR AS decision, 1 AS documents_present FROM sessions WHERE session_id::BIGINT % 7 <> 0 UNION ALL SELECT session_id, '2', committee, 'accepted', 0 FROM sessions WHERE session_id::BIGINT % 7 <> 0")
def local_index_agenda(spark, sf_dir):
    return folders.local_index(_folders(spark, sf_dir))[1].select("session_id", "number", "title", "decision", "documents_present")


@query(f"{_DOCS} SELECT row_number() OVER (ORDER BY session_id, d.id) AS id, session_id, title, agenda_item, url, local_path, '1998-01-01T00:00:00Z' AS retrieved_at FROM docs d JOIN orders ON o_orderkey::VARCHAR = session_id WHERE o_orderkey % 5 <> 0")
def local_index_documents(spark, sf_dir):
    """Documents of all manifests with ids in the order of session and place."""
    d = folders.local_index(_folders(spark, sf_dir))[2]
    return folders.numbered(d, DOCUMENTS, "session_id", "place").select("id", "session_id", "title", "agenda_item", "url", "local_path", "retrieved_at")


def _detail_page() -> F.Column:
    k = _c("o_orderkey")
    row = lambda n, title, state, links: F.concat(F.lit(f"<tr><td>{n}</td><td>"), title, F.lit(f"</td><td>{state}</td><td>"), links, F.lit("</td></tr>"))
    link = F.concat(F.lit("<a href='getfile.asp?id="), k, F.lit("'></a><a href='getfile.asp?id="), k, F.lit("'>Vorlage "), k, F.lit("</a><a href='si0057.asp?x=1'>weiter</a>"))
    table = F.concat(F.lit("<table class='x Tagesordnung'><tr><th>Nr</th></tr>"), row("Ö 1", F.concat("o_orderpriority", F.lit("<br>Berichterstatterin: Frau "), k), "einstimmig beschlossen", F.lit("")), row("Ö 2", F.lit("Haushalt"), "vertagt", link), F.lit("</table>"))
    own = F.concat(F.lit("<div class=smc-documents><div class=smc-dg-ds-1><div class=smc-doc-icon><i>Protokoll</i></div><div class=smc-doc-content><a href='/do/getfile.asp?id=p"), k, F.lit("'>Niederschrift</a></div></div></div>"))
    return F.concat(own, table)


def _details(spark, sf_dir):
    return html_tables.session_details(load(spark, sf_dir, "orders").select(_c("o_orderkey").alias("session_id"), _detail_page().alias("html")), "https://x.example/r/")


@query("""SELECT o_orderkey::VARCHAR AS session_id, 'Ö 1' AS number, o_orderpriority AS title, 'Frau ' || o_orderkey AS reporter, 'einstimmig beschlossen' AS status, 0 AS documents_present FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'Ö 2', 'Haushalt', NULL, 'vertagt', 1 FROM orders""")
def detail_agenda(spark, sf_dir):
    return _details(spark, sf_dir)[0].select("session_id", "number", "title", "reporter", "status", "documents_present")


@query("""SELECT o_orderkey::VARCHAR AS session_id, 'Niederschrift' AS title, 'https://x.example/do/getfile.asp?id=p' || o_orderkey AS url, 'Protokoll' AS category, NULL::VARCHAR AS agenda_item FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'Vorlage ' || o_orderkey, 'https://x.example/r/getfile.asp?id=' || o_orderkey, NULL, 'Ö 2' FROM orders""")
def detail_documents(spark, sf_dir):
    return _details(spark, sf_dir)[1].select("session_id", "title", "url", "category", "agenda_item")


@query("SELECT p_partkey, 'page-2.png|page-' || (9 + p_size) || '.png|cover.png' AS names FROM part")
def page_images_in_order(spark, sf_dir):
    names = F.array(F.lit("cover.png"), F.concat(F.lit("page-"), (F.col("p_size") + 9).cast("string"), F.lit(".png")), F.lit("page-2.png"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.pages_in_order(names), "|").alias("names"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || chr(10) || 'zwei' WHEN 1 THEN p_name || ' ' || p_brand ELSE p_brand END AS text FROM part")
def text_for_index(spark, sf_dir):
    k = F.col("p_partkey") % 3
    pages = F.when(k == 0, F.array(F.struct(F.col("p_name").alias("text")), F.struct(F.lit("zwei").alias("text")), F.struct(F.lit("drei").alias("text"))))
    title = F.when(k == 1, F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", pdf_text.index_text(F.coalesce(pages, F.expr("cast(array() as array<struct<text:string>>)")), title, F.col("p_brand"), most_pages=2).alias("text"))


_STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'ok' ELSE 'error' END"


def _service_jobs(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    status = F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "ok").otherwise("error")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderdate", status.alias("status"))


@query(f"SELECT o_orderkey AS job_id, {_STATE} AS status FROM orders WHERE o_orderkey % 4 < 2")
def active_jobs(spark, sf_dir):
    return jobs.active(_service_jobs(spark, sf_dir)).select("job_id", "status")


@query(f"SELECT o_orderkey AS job_id, {_STATE} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_jobs(spark, sf_dir):
    return jobs.latest(_service_jobs(spark, sf_dir), "o_orderdate").select("job_id", "status")


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "Ö 1").alias("agenda_item"), F.lit("vorlage").alias("document_type"), F.lit("high").alias("quality"), F.col("p_size").alias("chars"),
        F.lit("modell").alias("model_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("response"),
    )


@query("""WITH a AS (SELECT p_partkey AS job_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS response, '# Dokument-Analyse: ' || p_name || chr(10) || chr(10) || '- TOP: ' || CASE WHEN p_size % 2 = 0 THEN 'Ö 1' ELSE '' END || chr(10) || '- Typ: vorlage' || chr(10) || '- Extraktionsqualitaet: high (' || p_size || ' Zeichen)' || chr(10) || '- Modell: modell' || chr(10) || chr(10) || '## KI-Antwort' || chr(10) || chr(10) AS head FROM part)
SELECT job_id, 'markdown' AS output_format, head || response AS content FROM a UNION ALL SELECT job_id, 'ki_response', response FROM a WHERE response <> ''""")
def document_outputs(spark, sf_dir):
    return jobs.document_outputs(_answers(spark, sf_dir)).select("job_id", "output_format", "content")


@query("""SELECT o_orderkey AS job_id, 'raw_analysis' AS output_type FROM orders UNION ALL SELECT o_orderkey, 'structured_analysis' FROM orders UNION ALL SELECT o_orderkey, 'journalistic_article' FROM orders
UNION ALL SELECT o_orderkey, 'publication_draft' FROM orders WHERE o_orderkey % 6 = 0""")
def job_outputs(spark, sf_dir):
    k = F.col("o_orderkey")
    j = load(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 2 == 0, "journalistic_publication").otherwise("fact_extraction").alias("purpose"), F.when(k % 3 == 0, "done").otherwise("error").alias("status"))
    return jobs.workflow_outputs(j).select("job_id", "output_type")


def _provider(prompt: str, context: str) -> str:
    if prompt.endswith("0"):
        raise ValueError("no answer")
    return f"{prompt}|{context}"


@query("SELECT p_partkey AS job_id, CASE WHEN p_size % 10 = 0 THEN '' ELSE 'p' || p_size || '|# ' || p_name END AS response, CASE WHEN p_size % 10 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN p_size % 10 = 0 THEN 'no answer' ELSE '' END AS error_message, 'm' AS model_name FROM part")
def provider_answers(spark, sf_dir):
    df = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.concat(F.lit("# "), "p_name", F.lit("\n\n## Prompt-Hinweis\nbitte")).alias("context"), F.concat(F.lit("p"), _c("p_size")).alias("prompt"))
    return analysis.answered(df, _provider, "none", "m").select("job_id", "response", "status", "error_message", "model_name")


@query("""SELECT p_partkey, p_partkey % 4 < 3 AS source_available, CASE p_partkey % 4 WHEN 0 THEN 'pdf_attachment' WHEN 1 THEN 'text_excerpt' ELSE 'metadata_only' END AS transfer_mode, CASE WHEN p_partkey % 4 = 1 THEN repeat('x', least(12000, 6000 + p_size * 200)) ELSE '' END AS excerpt FROM part""")
def document_excerpts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    path = F.concat(_c("p_partkey"), F.when(k == 0, ".PDF").when(k == 1, ".md").when(k == 2, ".docx").otherwise(".txt"))
    d = load(spark, sf_dir, "part").select("p_partkey", "p_size", path.alias("resolved_path"))
    files = d.where(k < 3).select(F.col("resolved_path").alias("path"), F.repeat(F.lit("x"), F.col("p_size") * 200 + 6000).alias("text"))
    return analysis.enriched(d, files).select("p_partkey", "source_available", "transfer_mode", "excerpt")


_TEMPLATES = """tpl AS (SELECT p_partkey::VARCHAR AS id, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'session' ELSE 'tops' END AS scope, p_partkey % 3 <> 0 AS is_active, p_size::INT AS revision FROM part)"""


def _templates(spark, sf_dir):
    scope = F.when(F.col("p_partkey") % 2 == 0, "session").otherwise("tops")
    member = F.to_json(F.struct(_c("p_partkey").alias("id"), F.col("p_name").alias("name"), scope.alias("scope"), F.lit("{{committee}} {{session_date}}").alias("text"), F.when(F.col("p_partkey") % 3 == 0, "inaktiv").otherwise("yes").alias("is_active"), _c("p_size").alias("revision")))
    files = load(spark, sf_dir, "part").select(F.concat(F.lit('{"templates": ['), member, F.lit(", 5]}")).alias("value"))
    return prompts.read_templates(files)


@query(f"WITH {_TEMPLATES} SELECT id, label, scope AS scopes, revision FROM tpl WHERE scope = 'tops' AND is_active")
def templates_listed(spark, sf_dir):
    return prompts.listed(_templates(spark, sf_dir), "tops", only_active=True).select("id", "label", F.array_join("scopes", ",").alias("scopes"), "revision")


@query(f"WITH {_TEMPLATES} SELECT id, label, CASE WHEN id::BIGINT % 5 = 0 THEN revision + 1 ELSE revision END AS revision, CASE WHEN id::BIGINT % 5 = 0 THEN 'agenda_item' END AS variables FROM tpl")
def templates_saved(spark, sf_dir):
    """Every fifth template is changed."""
    all_ = _templates(spark, sf_dir)
    changed = all_.where("id % 5 = 0").withColumns({"prompt_text": F.lit("{{ agenda_item }}"), "visibility": F.lit("shared")})
    return prompts.save(all_, changed).select("id", "label", "revision", F.nullif(F.array_join(F.coalesce("variables", F.expr("cast(array() as array<string>)")), ","), F.lit("")).alias("variables"))


@query(f"WITH {_TEMPLATES} SELECT id, label, revision, is_active FROM tpl WHERE id <> '2' UNION ALL SELECT id, label, revision, false FROM tpl WHERE id = '2' UNION ALL SELECT 'copy', label || ' (Kopie)', 1, true FROM tpl WHERE id = '1'")
def templates_copied(spark, sf_dir):
    """One is copied under a new id, and one switched off."""
    return prompts.deactivated(prompts.duplicated(_templates(spark, sf_dir), "1", "copy"), "2").select("id", "label", "revision", "is_active")


@query("""SELECT p_partkey::VARCHAR AS id, concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'label is required' END, CASE WHEN p_partkey % 3 = 0 THEN 'scope must be one of document, session, tops' END, CASE WHEN p_partkey % 5 = 0 THEN 'prompt_text is required' END,
CASE WHEN p_partkey % 7 = 0 THEN 'revision must be >= 1' END, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 11 = 0 THEN 'unknown placeholders: a, b' END) AS problems FROM part""")
def template_problems(spark, sf_dir):
    k = F.col("p_partkey")
    df = load(spark, sf_dir, "part").select(
        _c("p_partkey").alias("id"), F.when(k % 2 == 0, " ").otherwise("x").alias("label"), F.when(k % 3 == 0, F.array(F.lit("page"))).otherwise(F.array(F.lit("tops"))).alias("scopes"),
        F.when(k % 5 == 0, "").when(k % 11 == 0, "{{b}} {{ a }} {{committee}}").otherwise("{{committee}}").alias("prompt_text"), F.lit("shared").alias("visibility"), F.when(k % 7 == 0, 0).otherwise(3).alias("revision"),
    )
    return df.select("id", F.array_join(prompts.problems(), "; ").alias("problems"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_custkey NOT IN (SELECT p_partkey FROM part) THEN 'missing' WHEN o_custkey % 3 = 0 THEN 'inactive' WHEN o_custkey % 2 = 0 THEN 'wrong_scope' END AS error FROM orders
UNION ALL SELECT -o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE 'unreadable' END FROM orders""")
def template_choices(spark, sf_dir):
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 7 != 0, _c("o_custkey")).alias("template_id"), F.lit("tops").alias("scope"))
    without = prompts.choice_error(asked.withColumn("request_id", -F.col("request_id")), None)
    return prompts.choice_error(asked, _templates(spark, sf_dir)).unionByName(without).select("request_id", "error")
