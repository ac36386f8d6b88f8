"""python -m ratlas build|online|vectors|coverage|list|show|search|export: the index from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ratlas import schemas
from ratlas.functions import dates
from ratlas.operators import index, sessions, vector_index, vectors
from ratlas.sources import folders, html_tables, sinks

VECTORS = "id bigint, dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>"
TABLES = {"sessions": schemas.SESSIONS, "agenda_items": schemas.AGENDA_ITEMS, "documents": schemas.DOCUMENTS}


def read(spark: SparkSession, root: str):
    return [folders.read_or_empty(spark, f"{root}/{name}", schema) for name, schema in TABLES.items()]


def build(spark: SparkSession, raw: str, root: str, target: str, refresh_existing: bool = False, only_refresh: bool = False) -> None:
    """The index at root with the folders below raw, written to target (another folder, so that root stays whole)."""
    old = read(spark, root)
    found = folders.session_folders(folders.raw_files(spark, raw))
    take = index.to_refresh(found.select("session_id").distinct(), old[0].select("session_id"), old[2].select("session_id"), refresh_existing, only_refresh)
    new, agenda, documents = folders.local_index(found.join(take, "session_id", "left_semi"))
    agenda, documents = folders.numbered(agenda, schemas.AGENDA_ITEMS, "folder", "place"), folders.numbered(documents, schemas.DOCUMENTS, "folder", "place")
    index.upsert(old[0], new, "session_id").write.parquet(f"{target}/sessions")
    for name, before, rows in (("agenda_items", old[1], agenda), ("documents", old[2], documents)):
        last = before.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        index.replace_children(before, rows.withColumn("id", F.col("id") + last), take).write.parquet(f"{target}/{name}")


def online(spark: SparkSession, pages: str, root: str, target: str, base: str) -> None:
    """The sessions at root with those of month pages (page_id, year, month, html) in their place, written to target; of
    pages that show one session the first counts."""
    found = sessions.first_seen(html_tables.overview_sessions(spark.read.parquet(pages), base), "page_id", "place")
    y, m = dates.year_month(F.col("date"))
    rows = schemas.conform(found.withColumns({"year": y, "month": m}), schemas.SESSIONS)
    index.upsert(folders.read_or_empty(spark, f"{root}/sessions", schemas.SESSIONS), rows, "session_id").write.parquet(f"{target}/sessions")


def build_vectors(spark: SparkSession, root: str, stored: str, target: str, limit: int | None = None) -> None:
    """The vectors at stored after a build over the documents at root, written to target. The stand-in embedder hashes the
    words of title, type and agenda item."""
    s, _, documents = read(spark, root)
    known = vector_index.documents_for_index(documents, s)
    said = known.select("id", F.concat_ws(" ", "title", "document_type", "agenda_item").alias("text"))

    def vectorize(new):
        return vectors.pair_vectors(new.select("id", vectors.hashing_embedder()("text").alias("dense")), vectors.sparse_vectors(new.withColumn("text", F.concat(F.col("text"), F.lit(" dokument")))))

    old = folders.read_or_empty(spark, stored, VECTORS)
    vector_index.build(said, old, vectorize, limit).write.parquet(target)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ratlas", description=__doc__)
    p.add_argument("--index", required=True)
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("--raw", required=True)
    b.add_argument("--target", required=True)
    b.add_argument("--refresh-existing", action="store_true")
    b.add_argument("--only-refresh", action="store_true")
    o = sub.add_parser("online")
    for name in ("--pages", "--target", "--base"):
        o.add_argument(name, required=True)
    v = sub.add_parser("vectors")
    v.add_argument("--stored", required=True)
    v.add_argument("--target", required=True)
    v.add_argument("--limit", type=int)
    sub.add_parser("coverage").add_argument("--stored", required=True)
    one = sub.add_parser("list")
    one.add_argument("--committee", default="")
    one.add_argument("--limit", type=int, default=30)
    sub.add_parser("show").add_argument("session_id")
    sub.add_parser("search").add_argument("query")
    e = sub.add_parser("export")
    e.add_argument("--out", required=True)
    for name in ("--session-id", "--committee", "--document-type"):
        e.add_argument(name, action="append", default=[])
    for name in ("--date-from", "--date-to"):
        e.add_argument(name, default="")
    e.add_argument("--require-local-path", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "build":
        build(spark, a.raw, a.index, a.target, a.refresh_existing, a.only_refresh)
        return 0
    if a.what == "online":
        online(spark, a.pages, a.index, a.target, a.base)
        return 0
    if a.what == "vectors":
        build_vectors(spark, a.index, a.stored, a.target, a.limit)
        return 0
    s, agenda, documents = read(spark, a.index)
    if a.what == "coverage":
        index.coverage(documents, folders.read_or_empty(spark, a.stored, VECTORS), "id").show(truncate=False)
    elif a.what == "list":
        sessions.index_list(s, a.committee, a.limit).select("session_id", "date", "committee", "meeting_name").show(a.limit, False)
    elif a.what == "show":
        found = s.where(F.col("session_id") == a.session_id)
        if found.isEmpty():
            print("unknown session")
            return 1
        sessions.display(found).select("session_id", "display_date", "display_name", "detail_url").show(truncate=False)
        sessions.by_agenda(agenda.where(F.col("session_id") == a.session_id), documents.where(F.col("session_id") == a.session_id)).select("number", "title", "decision", "document_count").show(1000, False)
    elif a.what == "search":
        sessions.search(documents, s, a.query).select("id", "display_date", "committee", "agenda_item", "title", "display_type").show(sessions.MOST_RESULTS, False)
    else:
        filters = {"session_ids": a.session_id, "names": a.committee, "date_from": a.date_from, "date_to": a.date_to, "types": a.document_type, "require_path": a.require_local_path}
        sinks.write_values(sessions.export_json(sessions.export_batch(documents, s, agenda, **filters), **filters), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
