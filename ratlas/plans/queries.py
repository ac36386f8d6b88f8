"""A query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.functions import dates, jsonx, paths, text, urls
from ratlas.operators import analysis, index, jobs, prompts, sessions, vectors
from ratlas.plans import tables as t
from ratlas.plans.tables import AGENDA_SQL, DOCUMENTS_SQL, SESSIONS_SQL, load
from ratlas.sources import html_tables, pdf_text, sinks

TODAY = "1998-10-03"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BOTH = f"WITH {SESSIONS_SQL}, {DOCUMENTS_SQL}"
ALL = f"WITH {SESSIONS_SQL}, {AGENDA_SQL}, {DOCUMENTS_SQL}"
ORDER_SQL = "ORDER BY date DESC NULLS LAST, committee ASC NULLS FIRST"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"{ALL} SELECT session_id, date, committee, meeting_name, coalesce(a.n, 0)::BIGINT AS top_count, coalesce(d.n, 0)::BIGINT AS document_count FROM sessions LEFT JOIN (SELECT session_id, count(*) n FROM agenda GROUP BY 1) a USING (session_id) LEFT JOIN (SELECT session_id, count(*) n FROM docs GROUP BY 1) d USING (session_id)")
def session_overview_counts(spark, sf_dir):
    return sessions.overview(t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), t.documents(spark, sf_dir)).select("session_id", "date", "committee", "meeting_name", "top_count", "document_count")


@query(f"WITH {SESSIONS_SQL}, {AGENDA_SQL} SELECT session_id, date, committee, CASE WHEN date < '{TODAY}' THEN 'vergangen' WHEN date = '{TODAY}' THEN 'heute' ELSE 'kommend' END AS session_status, count(a.id)::BIGINT AS top_count FROM sessions LEFT JOIN agenda a USING (session_id) WHERE date BETWEEN '1996-01-01' AND '1999-12-31' AND committee = '1-URGENT' AND date < '{TODAY}' AND (lower(meeting_name) LIKE '%sitzung f%' OR lower(committee) LIKE '%sitzung f%') GROUP BY ALL")
def session_list_filtered(spark, sf_dir):
    f = sessions.Filters("1996-01-01", "1999-12-31", "1-URGENT", "vergangen", "Sitzung F")
    return sessions.listing(t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), f, TODAY).select("session_id", "date", "committee", "session_status", "top_count")


@query(f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN date < '{TODAY}' THEN 'vergangen' WHEN date = '{TODAY}' THEN 'heute' ELSE 'kommend' END AS session_status, CASE WHEN date < '{TODAY}' THEN 'vergangene Sitzung' WHEN date = '{TODAY}' THEN 'heutige Sitzung' ELSE 'zukünftige Sitzung' END AS state FROM sessions")
def session_states(spark, sf_dir):
    return sessions.with_status(t.sessions(spark, sf_dir), TODAY).select("session_id", "session_status", dates.session_state(F.col("date"), TODAY).alias("state"))


@query(f"WITH {SESSIONS_SQL} SELECT DISTINCT committee FROM sessions WHERE committee IS NOT NULL AND committee <> ''")
def committees_distinct(spark, sf_dir):
    return sessions.committees(t.sessions(spark, sf_dir))


_SEARCH = " AND ".join("(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for c in sessions.SEARCHED) + ")" for w in ("widget", "high", "ö"))


@query(f"{BOTH} SELECT id, session_id, title, committee, date, substr(date, 9, 2) || '.' || substr(date, 6, 2) || '.' || substr(date, 1, 4) AS display_date, coalesce(nullif(document_type, ''), nullif(category, ''), nullif(content_type, ''), '-') AS display_type FROM docs LEFT JOIN sessions USING (session_id) WHERE {_SEARCH} {ORDER_SQL}, agenda_item NULLS FIRST, title NULLS FIRST, id LIMIT 100")
def search_multi_term(spark, sf_dir):
    return sessions.search(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), " Widget HIGH  Ö ").select("id", "session_id", "title", "committee", "date", "display_date", "display_type")


@query(f"WITH {SESSIONS_SQL} SELECT session_id, date, committee FROM sessions WHERE lower(committee) LIKE '%e%' ORDER BY date DESC NULLS LAST, lower(committee) NULLS FIRST, committee, session_id LIMIT 30")
def index_list_nocase(spark, sf_dir):
    return sessions.index_list(t.sessions(spark, sf_dir), "E").select("session_id", "date", "committee")


@query(f"{BOTH} SELECT d.id, d.session_id, d.agenda_item, d.title FROM docs d JOIN sessions USING (session_id) WHERE session_id = '7' AND coalesce(agenda_item, '') IN ('Ö 1', 'Ö 2', 'Ö 3')")
def scope_documents(spark, sf_dir):
    return sessions.scope_documents(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), "7", "tops", ["Ö 1", "Ö 2", "Ö 3"]).select("id", "session_id", "agenda_item", "title")


@query(f"{BOTH} SELECT d.id, d.session_id, d.agenda_item, d.title FROM docs d JOIN sessions USING (session_id) WHERE session_id = '7'")
def scope_documents_empty_selection(spark, sf_dir):
    return sessions.scope_documents(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), "7", "tops", []).select("id", "session_id", "agenda_item", "title")


_FIRST = "SELECT session_id, number, title FROM (SELECT *, row_number() OVER (PARTITION BY session_id, number ORDER BY id) AS i FROM agenda) WHERE i = 1"


@query(f"{ALL}, f AS ({_FIRST}) SELECT d.id, d.session_id, s.date, s.committee, d.agenda_item, f.title AS top_title, d.title, d.document_type FROM docs d JOIN sessions s USING (session_id) LEFT JOIN f ON f.session_id = d.session_id AND f.number = d.agenda_item WHERE s.date BETWEEN '1997-01-01' AND '1998-12-31' AND s.committee IN ('1-URGENT', '5-LOW') AND d.document_type IN ('protokoll', 'beschlussvorlage') AND trim(coalesce(local_path, '')) <> ''")
def export_batch(spark, sf_dir):
    out = sessions.export_batch(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), t.agenda(spark, sf_dir), (), ("5-LOW", "1-URGENT"), "1997-01-01", "1998-12-31", ("protokoll", "beschlussvorlage"), True)
    return out.select("id", "session_id", "date", "committee", "agenda_item", "top_title", "title", "document_type")


@query(f"WITH {AGENDA_SQL} {_FIRST}")
def first_title_per_key(spark, sf_dir):
    return sessions.first_titles(t.agenda(spark, sf_dir))


@query(f"WITH {AGENDA_SQL}, {DOCUMENTS_SQL} SELECT a.id, a.session_id, a.number, count(d.id)::BIGINT AS document_count, (count(*) FILTER (d.id IS NOT NULL AND trim(coalesce(d.local_path, '')) <> ''))::BIGINT AS available_count, coalesce(string_agg(d.title, '|' ORDER BY d.title, d.id), '') AS titles FROM (SELECT row_number() OVER () AS r, * FROM agenda) a LEFT JOIN docs d ON d.session_id = a.session_id AND coalesce(d.agenda_item, '') = a.number GROUP BY a.r, a.id, a.session_id, a.number")
def documents_by_agenda(spark, sf_dir):
    out = sessions.by_agenda(t.agenda(spark, sf_dir), t.documents(spark, sf_dir))
    return out.select("id", "session_id", "number", "document_count", "available_count", F.array_join("documents.title", "|").alias("titles"))


@query(f"WITH {SESSIONS_SQL} SELECT session_id, substr(date, 9, 2) || '.' || substr(date, 6, 2) || '.' || substr(date, 1, 4) AS display_date, trim(regexp_replace(replace(committee, '_', '-'), '-+', ' ', 'g')) AS display_committee, meeting_name AS display_name FROM sessions")
def session_display(spark, sf_dir):
    return sessions.display(t.sessions(spark, sf_dir)).select("session_id", "display_date", "display_committee", "display_name")


@query("SELECT o_orderkey::VARCHAR AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def incomplete_not_in(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("session_id"))
    return index.incomplete(t.sessions(spark, sf_dir).select("session_id"), d)


@query("SELECT o_orderkey::VARCHAR AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END FROM lineitem WHERE l_returnflag = 'R')")
def incomplete_not_in_null(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey").cast("string")).alias("session_id"))
    return index.incomplete(t.sessions(spark, sf_dir).select("session_id"), d)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_left_anti(spark, sf_dir):
    return index.missing(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphans(spark, sf_dir):
    return index.orphans(load(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("WITH c AS (SELECT DISTINCT doc_id FROM documents), i AS (SELECT DISTINCT doc_id FROM labels), n AS (SELECT count(c.doc_id)::BIGINT AS current, count(i.doc_id)::BIGINT AS indexed, (count(*) FILTER (c.doc_id IS NOT NULL AND i.doc_id IS NOT NULL))::BIGINT AS matched FROM c FULL JOIN i USING (doc_id)) SELECT current, indexed, matched, current - matched AS missing, indexed - matched AS orphaned, round_even(matched * 100.0::DOUBLE / current, 1) AS coverage_percent, CASE WHEN current <> matched OR indexed <> matched THEN 'needs_update' ELSE 'ok' END AS status FROM n")
def coverage_status(spark, sf_dir):
    return index.coverage(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(f"{BOTH} SELECT max(date) AS latest_session, (SELECT max(s.date) FROM sessions s JOIN docs d USING (session_id) WHERE trim(coalesce(s.date, '')) <> '') AS latest_document FROM sessions")
def latest_dates(spark, sf_dir):
    return index.latest_dates(t.sessions(spark, sf_dir), t.documents(spark, sf_dir))


@query(f"WITH {DOCUMENTS_SQL} SELECT id, (('0x' || substr(md5(coalesce(session_id, '') || '|' || coalesce(url, '') || '|' || coalesce(agenda_item, '')), 1, 16))::UBIGINT)::VARCHAR AS stable_id FROM docs")
def stable_ids(spark, sf_dir):
    return index.stable_ids(t.documents(spark, sf_dir)).select("id", F.col("stable_id").cast("string").alias("stable_id"))


@query(f"WITH {DOCUMENTS_SQL}, k AS (SELECT coalesce(session_id, '') || '|' || coalesce(url, '') || '|' || coalesce(agenda_item, '') AS k FROM docs) SELECT count(*)::BIGINT AS rows, count(DISTINCT k)::BIGINT AS ids, (count(*) - count(DISTINCT k))::BIGINT AS collisions FROM k")
def id_collisions(spark, sf_dir):
    return index.id_collisions(t.documents(spark, sf_dir))


_TYPE = "CASE WHEN lower(trim(coalesce(category, ''))) IN ('pr', 'ni') THEN 'protokoll' WHEN lower(trim(coalesce(category, ''))) IN ('bm', 'be', 'bek') THEN 'bekanntmachung' WHEN lower(trim(coalesce(category, ''))) = 'bv' THEN 'beschlussvorlage' WHEN lower(trim(coalesce(category, ''))) IN ('vo', 'vl') THEN 'vorlage' " + " ".join(f"WHEN contains(x, '{w}') THEN '{w}'" for w in text.TYPE_WORDS) + " ELSE 'sonstiges' END"


@query(f"WITH b AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'PR' WHEN 1 THEN 'BM' WHEN 2 THEN 'bv ' ELSE p_type END AS category, CASE p_size % 11 WHEN 0 THEN 'Beschlussprotokoll ' WHEN 1 THEN 'Vorlage ' ELSE '' END || p_name AS title FROM part), c AS (SELECT *, lower(title || ' ' || coalesce(category, '') || '  /vorlage-' || p_partkey % 3) AS y, lower(concat_ws(' ', title, category, '', CASE WHEN p_partkey % 3 = 0 THEN 'raw/bekanntmachung' ELSE '' END, '')) AS x FROM b) SELECT p_partkey, {_TYPE} AS document_type FROM c")
def doc_type_inference(spark, sf_dir):
    m, n = F.col("p_size") % 7, F.col("p_size") % 11
    category = F.when(m == 0, "PR").when(m == 1, "BM").when(m == 2, "bv ").otherwise(F.col("p_type"))
    title = F.concat(F.when(n == 0, "Beschlussprotokoll ").when(n == 1, "Vorlage ").otherwise(""), F.col("p_name"))
    url = F.when(F.col("p_partkey") % 3 == 0, "raw/bekanntmachung").otherwise("")
    return load(spark, sf_dir, "part").select("p_partkey", text.document_type(title, category, F.lit(None).cast("string"), url, F.lit("")).alias("document_type"))


@query("WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'einstimmig Beschlossen' WHEN 'click' THEN 'nicht zugestimmt' WHEN 'error' THEN 'ZURÜCKGESTELLT' WHEN 'signup' THEN 'ohne Beschluss' END AS status FROM events) SELECT event_id, CASE WHEN event_id % 1 = 0 AND status IN ('einstimmig Beschlossen', 'nicht zugestimmt') THEN 'accepted' WHEN status = 'ohne Beschluss' THEN 'rejected' END AS decision FROM s")
def decision_outcome(spark, sf_dir):
    e = F.col("event_type")
    status = F.when(e == "view", "einstimmig Beschlossen").when(e == "click", "nicht zugestimmt").when(e == "error", "ZURÜCKGESTELLT").when(e == "signup", "ohne Beschluss")
    return load(spark, sf_dir, "events").select("event_id", text.decision(status).alias("decision"))


@query("SELECT p_partkey, trim(p_name) AS title, CASE WHEN p_size % 3 <> 0 THEN 'Amt ' || p_brand END AS reporter FROM part")
def title_reporter_split(spark, sf_dir):
    m = F.col("p_size") % 3
    raw = F.concat(F.col("p_name"), F.when(m == 1, F.concat(F.lit(" - Berichterstatterin: Amt  "), F.col("p_brand"))).when(m == 2, F.concat(F.lit("\nBerichterstatter/in Amt "), F.col("p_brand"))).otherwise(""))
    title, reporter = text.title_and_reporter(raw)
    return load(spark, sf_dir, "part").select("p_partkey", title.alias("title"), reporter.alias("reporter"))


@query("WITH s AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), ''), 'document') AS s FROM pages) SELECT page_id, CASE WHEN length(s) > 40 THEN rtrim(substr(s, 1, 33), '-') || '-' || substr(sha1(s), 1, 6) ELSE s END AS slug FROM s")
def file_slug(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.file_slug(F.col("url"), 40).alias("slug"))


@query("SELECT o_orderkey, trim(regexp_replace(replace(o_orderpriority || '_rat--' || o_orderstatus, '_', '-'), '-+', ' ', 'g')) AS committee FROM orders")
def committee_humanize(spark, sf_dir):
    raw = F.concat(F.col("o_orderpriority"), F.lit("_rat--"), F.col("o_orderstatus"))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.humanize_committee(raw).alias("committee"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bald' WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS shown FROM orders")
def german_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "bald").when(k % 7 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.german(raw).alias("shown"))


def _day_values(df: DataFrame) -> DataFrame:
    d, m = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(m == 0, F.concat(F.lit("Mi, "), F.date_format(d, "dd.MM.yyyy"))).when(m == 1, F.concat(F.date_format(d, "d.M."), F.date_format(d, "yyyy"))).when(m == 2, F.concat(F.lit("Fr.,  "), F.date_format(d, "dd.MM."))).when(m == 3, F.date_format(d, "d.")).otherwise("31.02.2026")
    return df.select("o_orderkey", dates.day_value(raw, F.lit(2026), F.lit(2)).cast("string").alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CASE WHEN strftime(o_orderdate, '%m-%d') <> '02-29' THEN '2026' || strftime(o_orderdate, '-%m-%d') END WHEN 3 THEN CASE WHEN day(o_orderdate) <= 28 THEN '2026-02-' || strftime(o_orderdate, '%d') END END AS day FROM orders")
def day_value_parse(spark, sf_dir):
    return _day_values(load(spark, sf_dir, "orders"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'k' || page_id WHEN page_id % 3 = 1 THEN page_id::VARCHAR ELSE url END AS session_id FROM pages")
def url_session_id(spark, sf_dir):
    p = F.col("page_id")
    s = p.cast("string")
    url = F.when(p % 3 == 0, F.concat(F.lit("https://x.example/si0057.asp?__ksinr=1&SILFDNR=k"), s)).when(p % 3 == 1, F.concat(F.lit("https://x.example/a.asp?SID=&__kvid="), s)).otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", urls.session_id(url).alias("session_id"))


_BODY = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"WITH b AS (SELECT doc_id, length({_BODY}) AS n FROM documents) SELECT doc_id, n::BIGINT AS chars, CASE WHEN n = 0 THEN 'empty_text' WHEN n < 80 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN n = 0 THEN 'failed' WHEN n < 80 THEN 'low' WHEN n < 500 THEN 'medium' ELSE 'high' END AS quality FROM b")
def text_quality(spark, sf_dir):
    q = load(spark, sf_dir, "documents").select("doc_id", text.text_quality(F.col("text"), 2**31 - 1, F.lit(False)).alias("q"))
    return q.select("doc_id", F.col("q.chars").cast("long").alias("chars"), "q.status", "q.quality")


_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"


def _sections_sql() -> str:
    """Sections by one pattern each: its label, what follows as far as needed, and the first label that ends it."""
    one = lambda labels, stops: _STRIP.format(f"regexp_extract(b, '(?is)\\b(?:{'|'.join(labels)})\\b\\s*[:-]?\\s*(.*?)(?:\\b(?:{'|'.join(stops)})\\b|$)', 1)")
    rows = lambda kind: "[" + ", ".join(f"{{'name': '{name}', 'value': {one(labels, stops)}}}" for name, (labels, stops) in text.SECTIONS[kind].items()) + "]"
    lines = "regexp_replace(regexp_replace('Beschlussvorschlag: ' || coalesce(text, '') || chr(10) || 'Begruendung: ' || coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    body = _STRIP.format(f"regexp_replace({lines}, '\\n{{2,}}', chr(10), 'g')")
    value = lambda name: f"list_filter(x, lambda y: y.name = '{name}')[1].value"
    own = ", ".join(f"length({value(n)})::INT AS {n}_chars, sha256({value(n)}) AS {n}_sha256" for n in ("beschlusstext", "begruendung"))
    return f"""WITH d AS (SELECT doc_id, doc_id % 3 AS m, trim(coalesce(source, '')) <> '' AS titled, {body} AS b FROM documents),
f AS (SELECT *, list_filter(CASE m WHEN 0 THEN {rows("vorlage")} WHEN 1 THEN {rows("protokoll")} ELSE [] END, lambda y: y.value <> '') AS x FROM d)
SELECT doc_id, CASE WHEN m = 2 THEN 'unsupported_document_type' WHEN len(x) > 0 OR titled THEN 'ok' ELSE 'no_structured_fields' END AS status,
  CASE WHEN m = 2 THEN 'failed' WHEN len(x) >= 3 THEN 'high' WHEN len(x) >= 2 THEN 'medium' WHEN len(x) > 0 OR titled OR length(b) >= 120 THEN 'low' ELSE 'failed' END AS quality,
  coalesce(array_to_string(list_sort(list_transform(x, lambda y: y.name)), ','), '') AS sections, {own} FROM f"""


@query(_sections_sql())
def labelled_sections(spark, sf_dir):
    body = F.concat(F.lit("Beschlussvorschlag: "), text.as_text(F.col("text")), F.lit("\nBegruendung: "), text.as_text(F.col("text")))
    c = text.parse_content(F.when(F.col("doc_id") % 3 == 0, "Beschlussvorlage").when(F.col("doc_id") % 3 == 1, "protokoll").otherwise("brief"), body, F.col("source"))
    df = load(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    field = lambda x: F.try_element_at("c.fields", F.lit(x))
    own = [y for x in ("beschlusstext", "begruendung") for y in (F.length(field(x)).alias(f"{x}_chars"), F.sha2(field(x), 256).alias(f"{x}_sha256"))]
    return df.select("doc_id", "c.status", "c.quality", F.array_join("c.sections", ",").alias("sections"), *own)


_HEADED = "'Beschlussvorschlag: ' || {x} || ' BEGRUENDUNG : ' || {x} || ' Anlagen: keine'"
_HEADS = f"'(?is)(?:{'|'.join(text.HEADINGS)})\\s*:'"


@query(f"""WITH d AS (SELECT doc_id, {_HEADED.format(x="coalesce(text, '')")} AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, {_HEADS}) AS h, regexp_split_to_array(t, {_HEADS}) AS g FROM d),
e AS (SELECT doc_id, t, h, unnest(generate_series(1, len(h))) AS i, g FROM s),
p AS (SELECT doc_id, i, h[i] AS head, substr(t, list_sum(list_transform(g[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0)::BIGINT + 1, {text.ANCHOR_CHARS}) AS a FROM e),
q AS (SELECT doc_id, i, trim(regexp_replace(head, '\\s*:$', '')) AS heading, regexp_replace(regexp_replace(a, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS anchor FROM p)
SELECT doc_id, count(*)::BIGINT AS headings, string_agg(heading, '|' ORDER BY i) AS names, sha256(string_agg(anchor, '|' ORDER BY i)) AS anchors_sha256 FROM q GROUP BY doc_id""")
def section_headings(spark, sf_dir):
    x = text.as_text(F.col("text"))
    body = F.concat(F.lit("Beschlussvorschlag: "), x, F.lit(" BEGRUENDUNG : "), x, F.lit(" Anlagen: keine"))
    df = load(spark, sf_dir, "documents").select("doc_id", text.section_headings(body).alias("h"))
    return df.select("doc_id", F.size("h").cast("long").alias("headings"), F.array_join("h.heading", "|").alias("names"), F.sha2(F.array_join("h.anchor_text", "|"), 256).alias("anchors_sha256"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href FROM pages) SELECT page_id, replace(href, '&amp;', '&') AS href, count(*) AS links FROM l GROUP BY ALL")
def page_links(spark, sf_dir):
    return html_tables.links(load(spark, sf_dir, "pages").select("page_id", "html")).groupBy("page_id", "href").agg(F.count("*").alias("links"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href FROM pages) SELECT DISTINCT page_id, replace(href, '&amp;', '&') AS href FROM l")
def dedupe_links(spark, sf_dir):
    return html_tables.dedupe_links(html_tables.links(load(spark, sf_dir, "pages").select("page_id", "html"))).select("page_id", "href")


def _portal_page() -> F.Column:
    s = F.col("page_id").cast("string")
    row = F.concat(F.lit("<tr><td><span class=weekday>"), (F.col("page_id") % 28 + 1).cast("string"), F.lit(".</span><td class=silink><div class=smc-el-h>Rat "), s, F.lit("</div><a class='smc-link-normal' href='si0057.asp?__ksinr="), s, F.lit("'>Sitzung</a><ul><li>19:00 Uhr<li>Rathaus</ul>"))
    return F.concat(F.lit("<table id=smc_page_si0040_contenttable1>"), row, F.lit("<tr><td>-<td>Keine Sitzung</table>"), F.col("html"))


@query("SELECT page_id, page_id::VARCHAR AS session_id, 'Rat ' || page_id AS committee, 'Sitzung' AS meeting_name, '2025-10-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS date, '19:00 Uhr' AS start_time, 'Rathaus' AS location FROM pages")
def page_rows(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.lit(2025).alias("year"), F.lit(10).alias("month"), _portal_page().alias("html"))
    return html_tables.overview_sessions(p, "https://x.example/").select("page_id", "session_id", "committee", "meeting_name", "date", "start_time", "location")


#: The query vector of the retrieval queries: the same for every engine.
VECTOR = [((7 * i) % 13 - 6) / 6 for i in range(64)]
TERMS = ("the", "of", "and")
_V = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
_COS = f"dense AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_V}) AS score FROM embeddings WHERE %s)"
_TOK = "sparse AS (SELECT id, sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256))) AS score FROM (SELECT d.doc_id AS id, len(t)::DOUBLE AS n, len(list_filter(t, lambda x: x = q.q))::DOUBLE AS tf FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]{2,}') AS t FROM documents WHERE %s) d, (VALUES ('the'), ('of'), ('and')) q(q)) WHERE tf > 0 GROUP BY id)"
_FUSE = "r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM dense QUALIFY k <= 30 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM sparse QUALIFY k <= 30) SELECT id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS score FROM r GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + k)) DESC, id LIMIT 10"


def _vectors(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


def _texts(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10).cast("int").alias("label"))


@query(f"WITH {_COS % 'true'} SELECT id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, id LIMIT 30")
def cosine_topk(spark, sf_dir):
    return vectors.top(vectors.cosine(_vectors(spark, sf_dir), VECTOR), 30).withColumn("score", F.round("score", 6))


@query(f"WITH {_TOK % 'true'} SELECT id, round(score, 6) AS score FROM sparse ORDER BY sparse.score DESC, id LIMIT 30")
def sparse_topk(spark, sf_dir):
    return vectors.top(vectors.term_scores(_texts(spark, sf_dir), TERMS), 30).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS % 'true'}, {_TOK % 'true'}, {_FUSE}")
def hybrid_rrf(spark, sf_dir):
    return vectors.hybrid(_vectors(spark, sf_dir), _texts(spark, sf_dir), VECTOR, TERMS, 10).withColumn("score", F.round("score", 9))


@query(f"WITH {_COS % 'label = 3'}, {_TOK % 'doc_id % 10 = 3'}, {_FUSE}")
def hybrid_rrf_filtered(spark, sf_dir):
    return vectors.hybrid(_vectors(spark, sf_dir), _texts(spark, sf_dir), VECTOR, TERMS, 10, F.col("label") == 3).withColumn("score", F.round("score", 9))


@query("SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 4 = 0 THEN 'neu' ELSE o_orderstatus END AS meeting_name FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0")
def upsert_sessions(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("meeting_name"))
    new = rows.where("session_id % 4 = 0").select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).withColumn("meeting_name", F.when(F.col("place") == 2, "neu").otherwise("alt"))
    return index.upsert(rows.where("session_id % 3 <> 0"), new, "session_id", "place")


@query("SELECT l_orderkey AS session_id, l_linenumber AS number, CASE WHEN l_orderkey % 5 = 0 THEN 'neu' ELSE l_returnflag END AS status FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber <= 2")
def replace_children(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("status"))
    new = rows.where("session_id % 5 = 0 AND number <= 2").withColumn("status", F.lit("neu"))
    return index.replace_children(rows, new, load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("session_id")))


@query("WITH k AS (SELECT o_orderkey AS session_id, o_orderkey % 2 = 0 AS known FROM orders), d AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') SELECT session_id FROM k WHERE NOT known OR session_id NOT IN (SELECT l_orderkey FROM d)")
def refresh_decision(spark, sf_dir):
    new = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    d = load(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("session_id"))
    return index.to_refresh(new, new.where("session_id % 2 = 0"), d)


@query("WITH e AS (SELECT event_id, 'etag-' || user_id AS new_tag, CASE WHEN event_id % 3 = 0 THEN 'etag-' || user_id WHEN event_id % 3 = 1 THEN 'x' END AS old_tag, event_type FROM events) SELECT event_id, CASE WHEN old_tag IS NOT NULL THEN old_tag = new_tag ELSE event_type = 'view' END AS unchanged FROM e")
def unchanged_documents(spark, sf_dir):
    m, tag = F.col("event_id") % 3, F.concat(F.lit("etag-"), F.col("user_id").cast("string"))
    old = F.when(m == 0, tag).when(m == 1, "x")
    same = urls.unchanged(old, tag, F.lit("view"), F.col("event_type"), F.lit(5), F.lit(5))
    return load(spark, sf_dir, "events").select("event_id", same.alias("unchanged"))


@query("WITH j AS (SELECT user_id AS id, min(ts) AS ts, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), f AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), w AS (SELECT 'workflow:' || id AS job_id, id::VARCHAR AS db_job_id, ['workflow'] AS sources, n::VARCHAR AS status, '' AS purpose, id FROM j UNION ALL SELECT 'local:' || id, id::VARCHAR, ['local'], '' , n::VARCHAR, id FROM l), m AS (SELECT f.id, f.n, CASE WHEN j.id IS NOT NULL THEN 'workflow:' || f.id WHEN l.id IS NOT NULL THEN 'local:' || f.id ELSE f.id::VARCHAR END AS job_id FROM f LEFT JOIN j USING (id) LEFT JOIN l USING (id)) SELECT coalesce(w.job_id, m.job_id) AS job_id, array_to_string(list_sort(list_concat(coalesce(sources, []), CASE WHEN m.id IS NULL THEN [] ELSE ['files'] END)), ',') AS sources, coalesce(nullif(w.status, ''), '') AS status, coalesce(nullif(w.purpose, ''), m.n::VARCHAR, '') AS purpose FROM w FULL JOIN m USING (job_id)")
def union_merge_jobs(spark, sf_dir):
    count = lambda e, c: load(spark, sf_dir, "events").where(F.col("event_type") == e).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias(c))
    db = jobs.namespaced(count("view", "status"), "workflow").unionByName(jobs.namespaced(count("error", "purpose"), "local"))
    files = jobs.resolve_files(count("click", "purpose").withColumn("source", F.lit("files")), db)
    return jobs.merge(db, files).select("job_id", F.array_join("sources", ",").alias("sources"), "status", "purpose")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 20")
def log_tail(spark, sf_dir):
    return jobs.log_tail(load(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("WITH e AS (SELECT * FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 50) SELECT event_id, event_type FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type FROM e")
def retained_jobs(spark, sf_dir):
    return jobs.retained(load(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") != "view", "event_id")


@query(f"{BOTH} SELECT d.id, (local_path <> '' AND (hash_ IS NOT NULL)) AS source_available FROM docs d LEFT JOIN sessions USING (session_id) LEFT JOIN (SELECT DISTINCT 'agenda/' || s_suppkey || '.pdf' AS hash_ FROM supplier WHERE s_suppkey % 2 = 0) f ON f.hash_ = d.local_path")
def source_availability(spark, sf_dir):
    files = load(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("agenda/"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("path"))
    return sessions.source_availability(t.documents(spark, sf_dir), t.sessions(spark, sf_dir), files).select("id", "source_available")


@query("SELECT o_orderkey, 'Rat ' || o_orderpriority || ' am ' || strftime(o_orderdate, '%Y-%m-%d') || ' {{unknown}}' AS rendered, 'committee,date,unknown' AS names FROM orders")
def prompt_render(spark, sf_dir):
    template = F.lit("Rat {{committee}} am {{ date }} {{unknown}}")
    values = {"committee": F.col("o_orderpriority"), "date": F.date_format("o_orderdate", "yyyy-MM-dd")}
    return load(spark, sf_dir, "orders").select("o_orderkey", text.render_template(template, values).alias("rendered"), F.array_join(text.placeholders(template), ",").alias("names"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'T' || user_id WHEN 1 THEN 'A' || user_id ELSE event_type END AS title, CASE WHEN event_id % 3 = 1 THEN 'teaser' ELSE '' END AS intro, CASE event_id % 3 WHEN 0 THEN '# T' || user_id || chr(10) || chr(10) || '## Quellen' || chr(10) || chr(10) || '1. Q (pdf) - u' || chr(10) || chr(10) || '3. Quelle' WHEN 1 THEN '# A' || user_id || chr(10) || chr(10) || 'teaser' ELSE '# ' || event_type END AS markdown FROM events")
def json_outputs(spark, sf_dir):
    m, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    plain = F.concat(F.lit('{"title": "T'), u, F.lit('", "sources": [{"title": "Q", "document_type": "pdf", "url": "u"}, "x", {}]}'))
    fenced = F.concat(F.lit('```json\n{"title": "T", "article": {"title": "A'), u, F.lit('", "teaser": "teaser"}}\n```'))
    df = load(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(m == 0, plain).when(m == 1, fenced).otherwise("{no json").alias("response"), F.col("event_type").alias("meeting_name"), F.lit("").alias("committee"))
    return jobs.publications(df).select(F.col("job_id").alias("event_id"), "title", "intro", "markdown")


@query("WITH o AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id AS job_id, string_agg(role, ',' ORDER BY turn) AS formats, coalesce(arg_min(text, turn) FILTER (role = 'assistant' AND coalesce(text, '') <> ''), '') AS answer FROM o GROUP BY conv_id")
def outputs_by_job(spark, sf_dir):
    o = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("id"), F.when(F.col("role") == "assistant", "markdown").otherwise(F.col("role")).alias("output_format"), F.col("text").alias("content"))
    df = jobs.outputs_by_job(o)
    return df.select("job_id", F.regexp_replace(F.array_join("formats", ","), "markdown", "assistant").alias("formats"), text.as_text(F.col("markdown")).alias("answer"))


@query("SELECT event_id, lower(event_type) IN ('view', 'click') OR event_type = 'error' AS active, greatest(1, coalesce(try_cast(props->>'$.k' AS INT), 1)) AS revision FROM events")
def tolerant_values(spark, sf_dir):
    e = F.col("event_type")
    word = F.when(e == "view", " True ").when(e == "click", "aktiv").when(e == "signup", "off").when(e == "purchase", "0").otherwise("vielleicht")
    return load(spark, sf_dir, "events").select("event_id", jsonx.tolerant_bool(word).alias("active"), jsonx.tolerant_int(F.get_json_object("props", "$.k")).alias("revision"))


@query(f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN year % 3 = 2 THEN '' ELSE session_path || '/a/' || session_id || '.pdf' END AS paths, CASE WHEN year % 2 = 0 THEN strftime(date::DATE, '%Y/%m/') || split_part(session_path, '/', -1) ELSE strftime(date::DATE, '%Y/%m/%Y-%m-%d-') || session_id END AS folder FROM sessions")
def path_resolution(spark, sf_dir):
    s, m = t.sessions(spark, sf_dir), F.col("year") % 3
    local = F.when(m == 0, F.concat(F.lit("a\\"), F.col("session_id"), F.lit(".pdf"))).when(m == 1, F.concat(F.lit("./b/../a//"), F.col("session_id"), F.lit(".pdf"))).otherwise("../../../../../x.pdf")
    folder = paths.output_folder(F.when(F.col("year") % 2 == 0, F.col("session_path")), F.col("date"), F.lit(""), F.col("session_id"))
    return s.select("session_id", F.array_join(paths.candidates(F.col("session_path"), local), "|").alias("paths"), folder.alias("folder"))


@query("SELECT o_orderkey::VARCHAR AS session_id, length('- Ö 1: Haushalt') + length(o_orderpriority) * 2 AS n, o_orderdate < TIMESTAMP '1998-10-03' AS past FROM orders")
def analysis_context(spark, sf_dir):
    s = t.sessions(spark, sf_dir)
    agenda = F.array(F.struct(F.lit("Ö 1").alias("number"), F.lit("Haushalt").alias("title"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("decision")))
    none = F.expr("cast(array() as array<struct<agenda_item:string,document_type:string,title:string,source_available:boolean,transfer_mode:string,resolved_path:string,url:string,excerpt:string>>)")
    text_ = analysis.context_markdown(F.struct("date", "committee", "meeting_name"), agenda, none, "session", [], F.lit(""), TODAY)
    df = s.select("session_id", "committee", text_.alias("x"))
    item, twice = F.regexp_extract("x", "(?m)^(- Ö 1: .*)$", 1), F.length("x") - F.length(F.replace("x", F.col("committee"), F.lit("")))
    return df.select("session_id", (F.length(item) + twice).cast("long").alias("n"), F.contains("x", F.lit("vergangene Sitzung")).alias("past"))


@query(f"WITH {SESSIONS_SQL}, {AGENDA_SQL} SELECT session_id, count(a.id)::BIGINT AS items, (count(*) FILTER (status = 'beschlossen'))::BIGINT AS accepted, (count(*) FILTER (status = 'vertagt'))::BIGINT AS rejected FROM sessions LEFT JOIN agenda a USING (session_id) GROUP BY session_id")
def agenda_summaries(spark, sf_dir):
    agenda = t.agenda(spark, sf_dir).withColumns({"reporter": F.lit(None).cast("string"), "documents_present": F.lit(1)})
    out = sinks.agenda_summaries(t.sessions(spark, sf_dir), agenda, "t").withColumn("i", F.from_json("value", "agenda_items array<struct<decision:string>>"))
    count = lambda d: F.size(F.filter("i.agenda_items", lambda x: x["decision"] == d)).cast("long")
    return out.select("session_id", F.size("i.agenda_items").cast("long").alias("items"), count("accepted").alias("accepted"), count("rejected").alias("rejected"))


@query(f"WITH {SESSIONS_SQL}, {AGENDA_SQL} SELECT session_id, meeting_name AS session_title, coalesce(string_agg('- ' || number || ' ' || title, chr(10) ORDER BY a.id), '') AS source_list FROM sessions LEFT JOIN agenda a USING (session_id) GROUP BY session_id, meeting_name")
def prompt_context(spark, sf_dir):
    return prompts.context(t.sessions(spark, sf_dir), t.agenda(spark, sf_dir)).select("session_id", "session_title", "source_list")


@query("SELECT doc_id, 'ok' AS status, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') || ' eins zwei', ' +', ' ', 'g') || repeat(' lang', 20) AS text FROM documents")
def pdf_extraction(spark, sf_dir):
    stream = F.concat(F.lit("BT ("), F.col("source"), F.lit(" eins) Tj ET BT (zwei"), F.lit(" lang" * 20), F.lit(") Tj ET"))
    raw = F.concat(F.lit("1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << >> stream\n"), stream, F.lit("\nendstream endobj"))
    files = load(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), raw.cast("binary").alias("content"), F.lit("application/pdf").alias("content_type"), F.length(raw).cast("long").alias("length"))
    out = pdf_text.extract_files(files)
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "extraction.status", "extraction.text")


from ratlas.plans import index_queries, more_queries, source_queries  # noqa: E402, F401  (they register their queries)
