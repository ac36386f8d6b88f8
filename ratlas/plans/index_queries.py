"""Queries through stored indexes: the same rows, and the same SQL, as those of the scans beside them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratlas.functions import dates, urls
from ratlas.operators import postings, retrieval, sessions, trigrams
from ratlas.operators.bitmaps import Coverage
from ratlas.operators.vector_cells import Cells
from ratlas.plans import tables as t
from ratlas.plans.queries import ORACLE, TERMS, TODAY, VECTOR, _portal_page, _texts, _vectors, query
from ratlas.plans.tables import SESSIONS_SQL, load
from ratlas.sources import named_files, shared, sqlite, table_functions
from ratlas.sources.keyed import KeyedTable


def _posted(spark, sf_dir) -> str:
    path = f"{shared.folder(spark, 'postings')}/terms"
    postings.build(_texts(spark, sf_dir), path)
    return path


def _cells(spark, sf_dir) -> Cells:
    index = Cells(spark, shared.folder(spark, "cells"))
    index.build(_vectors(spark, sf_dir))
    return index


@query(ORACLE["sparse_topk"])
def sparse_topk_postings(spark, sf_dir):
    return postings.search(spark, _posted(spark, sf_dir), TERMS, 30).withColumn("score", F.round("score", 6))


@query(ORACLE["cosine_topk"])
def cosine_topk_cells(spark, sf_dir):
    return _cells(spark, sf_dir).search(VECTOR, 30).withColumn("score", F.round("score", 6))


@query(ORACLE["hybrid_rrf"])
def hybrid_rrf_indexed(spark, sf_dir):
    return retrieval.hybrid(_cells(spark, sf_dir), _posted(spark, sf_dir), VECTOR, TERMS).withColumn("score", F.round("score", 9))


@query(ORACLE["hybrid_rrf_filtered"])
def hybrid_rrf_filtered_indexed(spark, sf_dir):
    among = _texts(spark, sf_dir).where("label = 3").select("id")
    return retrieval.hybrid(_cells(spark, sf_dir), _posted(spark, sf_dir), VECTOR, TERMS, where=F.col("label") == 3, among=among).withColumn("score", F.round("score", 9))


@query(ORACLE["search_multi_term"])
def search_multi_term_trigrams(spark, sf_dir):
    d, s, path = t.documents(spark, sf_dir), t.sessions(spark, sf_dir), f"{shared.folder(spark, 'trigrams')}/documents"
    trigrams.index_documents(d, s, path)
    return trigrams.search(d, s, " Widget HIGH  Ö ", path).select("id", "session_id", "title", "committee", "date", "display_date", "display_type")


@query(ORACLE["session_list_filtered"])
def session_list_trigrams(spark, sf_dir):
    s, path = t.sessions(spark, sf_dir), f"{shared.folder(spark, 'trigrams')}/sessions"
    trigrams.build(s, ("meeting_name", "committee"), path, "session_id")
    f = sessions.Filters("1996-01-01", "1999-12-31", "1-URGENT", "vergangen", "Sitzung F")
    counts = t.agenda(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("top_count"))
    out = trigrams.filtered(s, f, TODAY, path).join(counts, "session_id", "left").fillna(0, ["top_count"])
    return out.select("session_id", "date", "committee", "session_status", "top_count")


def _keyed(spark, schema: str) -> KeyedTable:
    return KeyedTable(spark, f"{shared.folder(spark, 'keyed')}/table", schema, "session_id")


@query(ORACLE["upsert_sessions"])
def upsert_sessions_committed(spark, sf_dir):
    """The rows of upsert_sessions, brought by three commits of which the last is run twice."""
    table = _keyed(spark, "session_id bigint, meeting_name string")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("meeting_name"))
    new = rows.where("session_id % 4 = 0").select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).withColumn("meeting_name", F.when(F.col("place") == 2, "neu").otherwise("alt"))
    table.upsert(rows.where("session_id % 3 <> 0"), writer="q", batch=0)
    for batch, part in ((1, "session_id % 8 = 0"), (2, "session_id % 8 = 4"), (2, "session_id % 8 = 4")):
        table.upsert(new.where(part), "place", writer="q", batch=batch)
    return table.read()


@query(ORACLE["replace_children"])
def replace_children_committed(spark, sf_dir):
    """The rows of replace_children: all children of the refreshed sessions go in the commit that brings the new ones."""
    table = _keyed(spark, "session_id bigint, number int, status string")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("status"))
    table.apply(rows)
    refreshed = load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("session_id"))
    table.apply(rows.where("session_id % 5 = 0 AND number <= 2").withColumn("status", F.lit("neu")), refreshed)
    return table.read()


_STORED = "session_id string, date string, committee string, year int, place bigint"


@query(f"WITH {SESSIONS_SQL} SELECT session_id, date, committee, year, NULL::BIGINT AS place FROM sessions WHERE committee LIKE '1-%' AND year >= 1995 AND session_id <> '7'")
def sqlite_sessions(spark, sf_dir):
    """Sessions written to a store of SQLite files and read back, with conditions that run inside the files and a column
    that they lack."""
    path = f"{shared.folder(spark, 'sqlite')}/index"
    sqlite.write(t.sessions(spark, sf_dir).select("session_id", "date", "committee", "year"), path, "sessions")
    out = sqlite.read(spark, path, "sessions", _STORED, 20_000)
    none = [sqlite.read(spark, f"{path}/{x}", table, _STORED) for x, table in (("gone", "sessions"), ("", "gone"))]
    return out.unionByName(none[0]).unionByName(none[1]).where("committee LIKE '1-%' AND year >= 1995 AND session_id <> '7'")


@query("SELECT 'agenda/' || CASE WHEN s_suppkey % 10 = 0 THEN 'ten.' || row_number() OVER (PARTITION BY s_suppkey % 10 = 0 ORDER BY sha1(s_name || '|' || s_nationkey)) - 1 || '.txt' ELSE s_suppkey || '.txt' END AS name, sha1(s_name || '|' || s_nationkey) AS sha1 FROM supplier")
def document_bytes(spark, sf_dir):
    """Contents written as named files and read back; names that meet are numbered and none is replaced. Numbers follow the
    commit, so here they are put in the order of the contents."""
    root = shared.folder(spark, "files")
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("agenda/"), F.when(F.col("s_suppkey") % 10 == 0, "ten").otherwise(k), F.lit(".txt"))
    named_files.write(load(spark, sf_dir, "supplier").select(name.alias("name"), F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).alias("content")), root)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", "(agenda/.*)$", 1).alias("name"), F.sha1("content").alias("sha1"))
    ten = F.startswith("name", F.lit("agenda/ten"))
    place = F.row_number().over(Window.partitionBy(ten).orderBy("sha1")) - 1
    return back.where(~ten).unionByName(back.where(ten).withColumn("name", F.concat(F.lit("agenda/ten."), place.cast("string"), F.lit(".txt"))))


@query(ORACLE["page_rows"])
def page_rows_lateral(spark, sf_dir):
    table_functions.register(spark)
    pages = load(spark, sf_dir, "pages").select("page_id", _portal_page().alias("html"))
    df = spark.sql("SELECT p.page_id, r.* FROM {pages} p, LATERAL month_rows(p.html, 2025, 10) r", pages=pages)
    day = F.transform("day_texts", lambda x: dates.day_value(x, F.col("year"), F.col("month")))
    url = urls.absolute("https://x.example/", F.col("href"))
    df = df.withColumn("date", F.get(F.filter(day, lambda d: d.isNotNull()), F.lit(0)).cast("string")).where("date IS NOT NULL")
    return df.select("page_id", urls.session_id(url).alias("session_id"), "committee", "meeting_name", "date", "start_time", "location")


@query(ORACLE["coverage_status"])
def coverage_status_bitmaps(spark, sf_dir):
    """The row of coverage_status from bitmaps that three batches have left, one of them twice."""
    status = Coverage(spark, f"{shared.folder(spark, 'bitmaps')}/ids")
    d, n = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id")
    for batch in (0, 1, 2, 1):
        part = F.pmod("doc_id", F.lit(3)) == batch
        status.add("current", d.where(part), "doc_id", batch)
        status.add("indexed", n.where(part), "doc_id", batch)
    return status.coverage()
