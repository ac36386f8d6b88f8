"""Listing, searching, drilling down and exporting sessions and their documents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ratlas import schemas
from ratlas.functions import dates, text
from ratlas.functions.text import as_text, filled

#: Columns that metadata search looks into; most results it gives; document types of an export.
SEARCHED = ("title", "document_type", "category", "agenda_item", "local_path", "committee", "meeting_name", "session_id", "date")
MOST_RESULTS = 100
TYPES = ("protokoll", "bekanntmachung", "beschlussvorlage", "vorlage", "sonstiges")
#: Parts of a hash: of names below a session's path, and of the first folders of a listing.
NAME_PARTS, FIRST_PARTS = 64, 1024


@dataclass(frozen=True)
class Filters:
    date_from: str = ""
    date_to: str = ""
    committee: str = ""
    status: str = ""
    search: str = ""


def with_status(sessions: DataFrame, today: str) -> DataFrame:
    return sessions.withColumn("session_status", dates.session_status(F.col("date"), today))


def filtered(sessions: DataFrame, f: Filters, today: str) -> DataFrame:
    """The sessions that filters leave. A null date passes no range and no status; wildcards in search count."""
    df = with_status(sessions, today)
    if f.date_from:
        df = df.where(F.col("date") >= f.date_from)
    if f.date_to:
        df = df.where(F.col("date") <= f.date_to)
    if f.committee:
        df = df.where(F.col("committee") == f.committee)
    if f.status:
        df = df.where({"vergangen": F.col("date") < today, "heute": F.col("date") == today, "kommend": F.col("date") > today}[f.status])
    if f.search:
        like = f"%{f.search.lower()}%"
        df = df.where(F.lower("meeting_name").like(like) | F.lower("committee").like(like))
    return df


def listing(sessions: DataFrame, agenda: DataFrame, f: Filters = Filters(), today: str = "") -> DataFrame:  # noqa: B008
    """Filtered sessions with top_count, the latest first."""
    counts = agenda.groupBy("session_id").agg(F.count("*").alias("top_count"))
    df = filtered(sessions, f, today or dt.date.today().isoformat()).join(counts, "session_id", "left")
    return df.withColumn("top_count", F.coalesce("top_count", F.lit(0))).orderBy(F.col("date").desc_nulls_last(), F.col("committee").asc_nulls_first(), "session_id")


def overview(sessions: DataFrame, agenda: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions with top_count and document_count. Children are counted before the joins, so they don't multiply."""
    a = agenda.groupBy("session_id").agg(F.count("*").alias("top_count"))
    d = documents.groupBy("session_id").agg(F.count("*").alias("document_count"))
    df = sessions.join(a, "session_id", "left").join(d, "session_id", "left")
    return df.fillna(0, ["top_count", "document_count"]).orderBy(F.col("date").desc_nulls_last(), F.col("committee").asc_nulls_first(), "session_id")


def committees(sessions: DataFrame) -> DataFrame:
    return sessions.select("committee").where("committee IS NOT NULL AND committee <> ''").distinct().orderBy("committee")


def within(columns: Sequence[str], term: str) -> Column:
    """Whether a column holds a term that is in lower case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(as_text(F.col(c))), F.lit(term)) for c in columns])


def search(documents: DataFrame, sessions: DataFrame, query: str, limit: int = MOST_RESULTS) -> DataFrame:
    """Documents in which every word of the query occurs in at least one of SEARCHED, the latest first.

    Letters are folded as Unicode; a document without session is searched too. Blank queries find nothing. The display
    type is that of a result list: document type, category, content type, '-'.
    """
    s = sessions.select("session_id", "date", "committee", "meeting_name")
    df = documents.join(s, "session_id", "left")
    terms = query.lower().split()
    df = df.where(reduce(lambda a, b: a & b, [within(SEARCHED, t) for t in terms]) if terms else F.lit(False))
    df = df.withColumn("display_date", dates.german(F.col("date"))).withColumn("display_type", F.coalesce(*[filled(F.col(c)) for c in ("document_type", "category", "content_type")], F.lit("-")))
    order = [F.col("date").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in ("committee", "agenda_item", "title", "id")]]
    return df.orderBy(*order).limit(max(1, min(limit, MOST_RESULTS)))


def references(sessions: DataFrame) -> DataFrame:
    """Sessions as they are fetched: a committee without name is that of the meeting, and the other way round, else
    'Sitzung'."""
    committee, meeting = filled(F.col("committee")), filled(F.col("meeting_name"))
    return sessions.withColumns({"committee": F.coalesce(committee, meeting, F.lit("Sitzung")), "meeting_name": F.coalesce(meeting, committee, F.lit("Sitzung"))})


def reference(sessions: DataFrame, session_id: str) -> Row:
    """One session as it is fetched. LookupError tells of an id that isn't there, and of a session without detail_url."""
    found = references(sessions.where(F.col("session_id") == session_id)).limit(1).collect()
    if not found:
        raise LookupError(f"session {session_id!r} is not in the index")
    if not found[0]["detail_url"]:
        raise LookupError(f"session {session_id!r} has no detail_url")
    return found[0]


def index_list(sessions: DataFrame, committee: str = "", limit: int = 30) -> DataFrame:
    """Sessions of committees whose name holds a text, the latest first, committees in order without case."""
    df = sessions.where(F.lower("committee").like(f"%{committee.lower()}%")) if committee else sessions
    return df.orderBy(F.col("date").desc_nulls_last(), F.lower("committee").asc_nulls_first(), "committee", "session_id").limit(max(limit, 1))


def scope_documents(documents: DataFrame, sessions: DataFrame, session_id: str, scope: str, tops: Sequence[str]) -> DataFrame:
    """A session's documents with its data; with scope 'tops' those of the chosen items, of all if none is chosen."""
    df = documents.where(F.col("session_id") == session_id).join(sessions.select("session_id", "date", "committee", "meeting_name", "session_path"), "session_id")
    if scope == "tops" and tops:
        df = df.where(as_text(F.col("agenda_item")).isin(*tops))
    return df.orderBy(as_text(F.col("agenda_item")), F.col("title").asc_nulls_first(), "id")


def agenda_in_scope(agenda: DataFrame, scope: str, tops: Sequence[str]) -> DataFrame:
    """Agenda items of a scope; here scope 'tops' without a choice means none."""
    return agenda.where(F.col("number").isin(*tops) if tops else F.lit(False)) if scope == "tops" else agenda


def by_agenda(agenda: DataFrame, documents: DataFrame) -> DataFrame:
    """Agenda items with their documents (array by title) and document_count, available_count; a null number is ''."""
    available = F.btrim(as_text(F.col("local_path"))) != ""
    d = documents.groupBy("session_id", as_text(F.col("agenda_item")).alias("number_")).agg(
        F.array_sort(F.collect_list(F.struct("title", "id"))).alias("documents"), F.count("*").alias("document_count"), F.count_if(available).alias("available_count")
    )
    df = agenda.withColumn("number_", as_text(F.col("number"))).join(d, ["session_id", "number_"], "left").drop("number_")
    return df.withColumn("documents", F.coalesce("documents", F.expr("cast(array() as array<struct<title:string,id:bigint>>)"))).fillna(0, ["document_count", "available_count"])


def first_titles(agenda: DataFrame) -> DataFrame:
    """The title of the first agenda item by id for each session and number, even if it is null."""
    first = F.row_number().over(Window.partitionBy("session_id", "number").orderBy("id"))
    return agenda.withColumn("__i", first).where("__i = 1").select("session_id", "number", "title")


def export_batch(documents: DataFrame, sessions: DataFrame, agenda: DataFrame, session_ids: Sequence[str] = (), names: Sequence[str] = (), date_from: str = "", date_to: str = "", types: Sequence[str] = (), require_path: bool = False) -> DataFrame:
    """Documents of sessions with the title of their agenda item, in a fixed order. Unknown types and dates that
    aren't ISO raise ValueError before anything runs."""
    for d in filter(None, (date_from, date_to)):
        dt.date.fromisoformat(d)
    if bad := set(types) - set(TYPES):
        raise ValueError(f"unknown document types: {sorted(bad)}")
    s = sessions.select("session_id", "date", "committee", "meeting_name", "session_path")
    if session_ids:
        s = s.where(F.col("session_id").isin(*sorted(set(session_ids))))
    if names:
        s = s.where(F.col("committee").isin(*sorted(set(names))))
    if date_from:
        s = s.where(F.col("date") >= date_from)
    if date_to:
        s = s.where(F.col("date") <= date_to)
    d = documents.where(F.col("document_type").isin(*sorted(set(types)))) if types else documents
    if require_path:
        d = d.where(F.btrim(as_text(F.col("local_path"))) != "")
    top = first_titles(agenda).select("session_id", F.col("number").alias("agenda_item"), F.col("title").alias("top_title"))
    df = d.join(s, "session_id").join(top, ["session_id", "agenda_item"], "left")
    return df.orderBy("date", "session_id", as_text(F.col("agenda_item")), F.col("title").asc_nulls_first(), F.col("url").asc_nulls_first())


def export_json(batch: DataFrame, **filters: object) -> DataFrame:
    """One JSON text a document; the filters are echoed in every line, so that no task holds the whole export."""
    import json

    return batch.select(F.to_json(F.struct(F.lit(json.dumps(filters, sort_keys=True)).alias("filters"), *batch.columns)).alias("value"))


#: Canned filters of an export, each with the date preset 'Dieses Jahr', and canned choices of types.
PROFILES = {
    "Standardbatch (empfohlen)": {"names": (), "types": ("vorlage", "beschlussvorlage", "protokoll"), "require_path": True},
    "Rat (nur Quellenpaket)": {"names": ("Rat",), "types": ("vorlage", "beschlussvorlage", "protokoll"), "require_path": True},
    "Nur Protokolle": {"names": (), "types": ("protokoll",), "require_path": True},
    "Roh-Export": {"names": (), "types": (), "require_path": False},
}
TYPE_PROFILES = {
    "Priorisierte Dokumente": ("vorlage", "beschlussvorlage", "protokoll"),
    "Nur Protokolle": ("protokoll",),
    "Vorlagen und Beschluesse": ("vorlage", "beschlussvorlage"),
    "Alle Dokumenttypen": (),
}


def export_profile(name: str, documents: DataFrame, sessions: DataFrame, agenda: DataFrame, today: dt.date) -> DataFrame:
    """The export of a canned set of filters, for the current year."""
    first, last = dates.preset("Dieses Jahr", today)
    return export_batch(documents, sessions, agenda, date_from=first, date_to=last, **PROFILES[name])


def export_head(batch: DataFrame, generated_at: str, source_db: str, **filters: object) -> DataFrame:
    """One row that stands before an export's documents: generated_at, source_db, the filters as JSON (lists sorted,
    without repeats) and the number of documents."""
    import json

    plain = {k: sorted(set(v)) if isinstance(v, (list, tuple, set)) else v for k, v in filters.items()}
    n = batch.agg(F.count("*").alias("documents"))
    return n.select(F.lit(generated_at).alias("generated_at"), F.lit(source_db).alias("source_db"), F.lit(json.dumps(plain, sort_keys=True, ensure_ascii=False)).alias("filters"), "documents")


def export_preview(batch: DataFrame, rows: int = 3) -> DataFrame:
    """The first documents of an export, beside the number of all."""
    n = batch.agg(F.count("*").alias("document_count"))
    order = [F.col("date"), F.col("session_id"), as_text(F.col("agenda_item")), F.col("title").asc_nulls_first(), F.col("url").asc_nulls_first(), F.col("id")]
    return batch.orderBy(*order).limit(rows).join(F.broadcast(n))


def recent(sessions: DataFrame, rows: int = 5) -> DataFrame:
    """The latest sessions, ties by committee and id."""
    return sessions.orderBy(F.col("date").desc_nulls_last(), F.col("committee").asc_nulls_first(), "session_id").limit(rows)


def first_seen(rows: DataFrame, *order: str) -> DataFrame:
    """Sessions of several months' pages: of each session_id the row that comes first; rows without one are left out."""
    rest = [c for c in rows.columns if c != "session_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return rows.where("session_id IS NOT NULL AND session_id <> ''").groupBy("session_id").agg(first).select("session_id", "__r.*")


def _is_pdf(content_type: Column, path: Column) -> Column:
    return F.contains(F.lower(as_text(content_type)), F.lit("pdf")) | F.endswith(F.lower(as_text(path)), F.lit(".pdf"))


def pdf_documents(documents: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """id, session_id, title, path of PDF documents of known sessions whose file the listing (path) has."""
    pdfs = documents.where(_is_pdf(F.col("content_type"), F.col("local_path")))
    df = row_availability(pdfs, sessions, files).where("source_available AND session_path IS NOT NULL")
    title = F.coalesce(filled(F.col("title")), F.concat(F.lit("document-"), F.col("id").cast("string"), F.lit(".pdf")))
    return df.select("id", "session_id", title.alias("title"), F.concat_ws("/", F.rtrim("session_path", F.lit("/")), "local_path").alias("path"))


def pdf_paths(documents: Column) -> Column:
    """The paths of available PDF files among structs (source_available, resolved_path), in order."""
    there = F.filter(documents, lambda d: F.coalesce(d["source_available"], F.lit(False)) & F.endswith(F.lower(as_text(d["resolved_path"])), F.lit(".pdf")))
    return F.transform(there, lambda d: d["resolved_path"])


def display(sessions: DataFrame) -> DataFrame:
    """Sessions with display_date, display_committee and display_name.

    A stored slug is shown as words; where the committee is empty, its name comes from the session's path, and a
    meeting's own name comes first.
    """
    committee = F.col("committee")
    shown = F.when(as_text(committee) == "", text.committee_from_path(F.col("session_path"))).when(text.is_slug(committee), text.humanize_committee(committee)).otherwise(committee)
    name = F.coalesce(filled(F.btrim(as_text(F.col("meeting_name")))), shown, F.lit("Sitzung"))
    return sessions.withColumn("display_date", dates.german(F.col("date"))).withColumn("display_committee", as_text(shown)).withColumn("display_name", name)


def detail_type(documents: DataFrame) -> DataFrame:
    """The display type of a detail page: document type, content type, category, '-'."""
    return documents.withColumn("display_type", F.coalesce(*[filled(F.col(c)) for c in ("document_type", "content_type", "category")], F.lit("-")))


def _slashes(path: Column) -> Column:
    """A path with slashes, null if it is empty."""
    return filled(F.replace(as_text(path), F.lit("\\"), F.lit("/")))


def _listed_names(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session_id and what a listing (path) has below the session's path: names by a part of their hash, '' for that path
    itself. A file's path meets those of sessions cut at as many slashes as these have, so only paths of files travel."""
    own = _slashes(F.rtrim(as_text(F.col("session_path")), F.lit("/")))
    known = sessions.select("session_id", own.alias("__below")).where("session_id IS NOT NULL AND __below IS NOT NULL")
    parts = lambda path: F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1
    depths = known.agg(F.collect_set(parts(F.col("__below")))).scalar()
    cut = files.select("path", depths.alias("n")).select("path", F.explode(F.filter("n", lambda n: n <= parts(F.col("path")))).alias("n"))
    cut = cut.select(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("n")).alias("__below"), "path").select("__below", F.substr("path", F.length("__below") + 1).alias("__name")).where("__name <> '/'")
    names = cut.join(known, "__below").select("session_id", F.substr("__name", F.lit(2)).alias("__name")).repartition("session_id")
    parted = names.groupBy("session_id", _part(F.col("__name"), NAME_PARTS).alias("__part")).agg(F.collect_set("__name").alias("__names"))
    return parted.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("__part", "__names"))).alias("__listed"))


def _part(name: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")


def source_availability(documents: DataFrame, sessions: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """Documents with source_available: whether a listing (path) has their file, at its path or below its session's. more:
    further columns of the sessions, which are joined once.

    Documents travel to their sessions alone, and the listing is brought there. Only those whose own path begins as a
    listed one does, by a part of the hash of its first folder, are looked up by it before."""
    own, top = _slashes(F.col("local_path")), lambda path: _part(F.substring_index(path, "/", 1), FIRST_PARTS)
    begins = F.coalesce(F.array_contains(files.agg(F.collect_set(top(F.col("path")))).scalar(), top(own)), F.lit(False))
    listed = files.select(F.col("path").alias("__path")).distinct()
    looked_up = documents.where(begins).join(listed, own == F.col("__path"), "left").withColumn("__own", F.col("__path").isNotNull()).drop("__path")
    df = looked_up.unionByName(documents.where(~begins).withColumn("__own", F.lit(False)))
    df = df.join(sessions.select("session_id", "session_path", *more), "session_id", "left").join(_listed_names(sessions, files), "session_id", "left")
    below = F.array_contains(F.try_element_at("__listed", _part(as_text(own), NAME_PARTS)), as_text(own))
    return df.withColumn("source_available", F.col("__own") | F.coalesce(below, F.lit(False))).drop("__own", "__listed")


def row_availability(documents: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """As source_availability, for each row by its own paths. Rows pass by the listing twice, so documents are made and meet
    their sessions once, and aren't put together again by their ids."""
    listed = files.select(F.col("path").alias("__listed")).distinct()
    spread = F.concat(F.lit("\n"), F.col("id").cast("string"))  # rows without a path shouldn't meet in one task

    def looked_up(df: DataFrame, path: Column, flag: str) -> DataFrame:
        known = filled(F.replace(as_text(path), F.lit("\\"), F.lit("/")))
        return df.join(listed, F.coalesce(known, spread) == F.col("__listed"), "left").withColumn(flag, known.isNotNull() & F.col("__listed").isNotNull()).drop("__listed")

    df = looked_up(documents, F.col("local_path"), "__own").join(sessions.select("session_id", "session_path"), "session_id", "left")
    below = F.concat_ws("/", filled(F.rtrim(as_text(F.col("session_path")), F.lit("/"))), filled(as_text(F.col("local_path"))))
    return looked_up(df, below, "__below").withColumn("source_available", F.col("__own") | F.col("__below")).drop("__own", "__below")


def availability_counts(documents: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session_id, document_count, available_count, missing_count of every session, those without documents too."""
    there = F.col("source_available").cast("long")
    n = row_availability(documents, sessions, files).groupBy("session_id").agg(F.count("*").alias("document_count"), F.sum(there).alias("available_count"))
    df = sessions.select("session_id").join(n, "session_id", "left").fillna(0, ["document_count", "available_count"])
    return df.withColumn("missing_count", F.col("document_count") - F.col("available_count"))


def session_document(documents: DataFrame, session_id: str, document_id: int) -> DataFrame:
    """The document of a session with an id; none if it is another session's."""
    return documents.where((F.col("session_id") == session_id) & (F.col("id") == document_id))


def online_rows(found: DataFrame, known: DataFrame, refresh_existing: bool = False, only_refresh: bool = False) -> DataFrame:
    """Sessions of month pages (year, month, place and the columns of a session) as rows of the index: the first of each
    id by month and place, new ones, with refresh_existing known ones too, with only_refresh those alone. They have no
    folder yet, and their year and month are those of their date."""
    first = first_seen(found, "year", "month", "place")
    old = known.select("session_id").distinct()
    if only_refresh:
        first = first.join(old, "session_id", "left_semi")
    elif not refresh_existing:
        first = first.join(old, "session_id", "left_anti")
    year, month = dates.year_month(F.col("date"))
    return schemas.conform(first.withColumns({"year": year, "month": month, "session_path": F.lit(None).cast("string")}), schemas.SESSIONS)
