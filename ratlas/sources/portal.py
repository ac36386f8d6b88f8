"""A run over months of a portal as one flow of tables: pages, sessions, details, documents, contents, manifests.

Each step is a table below the run's folder and is read from there by the next. A run that is started again goes on behind
the last step that was written; what was fetched isn't asked for twice. The functions that fetch are passed in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.functions import text
from ratlas.operators import sessions as listing
from ratlas.sources import downloads, html_tables, named_files, sinks
from ratlas.sources.shared import path_of


def folder_of(date: Column, committee: Column, session_id: Column) -> Column:
    """A session's folder: year/month/date-committee-id."""
    return F.concat(F.replace(F.substring(date, 1, 7), F.lit("-"), F.lit("/")), F.lit("/"), date, F.lit("-"), text.file_slug(committee, 60), F.lit("-"), session_id)


class Run:
    """A run below root, which driver and executors share. fetch(url) gives content and headers or raises; base is the
    portal's address, and month_page the address of its month page without fields."""

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[str], downloads.Answer], base: str, month_page: str, attempts: int = 3, wait: float = 1.0):
        self.spark, self.root, self.fetch, self.base, self.month_page = spark, root.rstrip("/"), fetch, base, month_page
        self.attempts, self.wait = attempts, wait

    def _step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step; it counts as written once its writer has said so."""
        path = f"{self.root}/{name}"
        fs, done = path_of(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _fetched(self, asked: DataFrame) -> DataFrame:
        return downloads.fetched(asked, self.fetch, attempts=self.attempts, wait=self.wait)

    def pages(self, months: DataFrame) -> DataFrame:
        """page_id, year, month, html, url, error of the months' pages."""
        fields = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
        asked = downloads.month_requests(months.distinct()).select("year", "month", F.concat(F.lit(f"{self.month_page}?"), fields).alias("url"))
        page = (F.col("year") * 12 + F.col("month")).cast("long").alias("page_id")
        return self._step("pages", lambda: asked.join(self._fetched(asked), "url").select(page, "year", "month", F.decode("content", "utf-8").alias("html"), "url", "error"))

    def sessions(self, pages: DataFrame) -> DataFrame:
        """One row a session, from the first month that shows it, with its folder."""
        found = listing.first_seen(html_tables.overview_sessions(pages, self.base), "page_id", "place")
        return self._step("sessions", lambda: found.withColumn("folder", folder_of(F.col("date"), F.col("committee"), F.col("session_id"))))

    def details(self, sessions: DataFrame) -> DataFrame:
        """session_id, html, error of the sessions' own pages."""
        asked = sessions.select("session_id", F.col("detail_url").alias("url"))
        return self._step("details", lambda: asked.join(self._fetched(asked), "url").select("session_id", F.decode("content", "utf-8").alias("html"), "error"))

    def documents(self, details: DataFrame, agenda: DataFrame, found: DataFrame) -> DataFrame:
        """The documents of all sessions, each address fetched once, with content, path below the session's folder, error."""
        items = listing.first_titles(agenda.withColumnRenamed("place", "id")).select("session_id", F.col("number").alias("agenda_number"), F.col("title").alias("agenda_title"))
        order = (F.col("part") * 1_000_000 + F.col("place")).alias("place")
        rows = found.select("session_id", "title", "url", "category", "agenda_item", order)
        rows = rows.join(items, (rows["session_id"] == items["session_id"]) & (F.col("agenda_item") == F.col("agenda_number")), "left").drop(items["session_id"])
        return self._step("documents", lambda: downloads.named(rows.join(self._fetched(rows), "url").withColumn("old_path", F.lit(None).cast("string"))))

    def run(self, months: DataFrame) -> dict[str, DataFrame]:
        """All steps for months (year, month): the tables pages, sessions, details, agenda, documents and manifests; and,
        below files/, the documents' bytes and the manifests under the names that they have on disk."""
        pages = self.pages(months)
        sessions = self.sessions(pages)
        details = self.details(sessions)
        agenda, found = html_tables.session_details(details.where("html IS NOT NULL"), self.base)
        agenda = self._step("agenda", lambda: agenda)
        documents = self.documents(details, agenda, found)
        stored = documents.where("content IS NOT NULL")
        own = sessions.withColumn("retrieved_at", F.lit(None).cast("string"))
        manifests = self._step("manifests", lambda: sinks.manifests(own, downloads.entries(stored)))
        fs, done = path_of(self.spark, f"{self.root}/files/_done")
        if not fs.exists(done):  # names are given once, and nothing is replaced: what a broken run has left goes first
            fs.delete(done.getParent(), True)
            place = sessions.select("session_id", "folder")
            named = stored.join(place, "session_id").select(F.concat_ws("/", "folder", "path").alias("name"), "content")
            told = manifests.join(place, "session_id").select(F.concat("folder", F.lit("/manifest.json")).alias("name"), F.col("value").cast("binary").alias("content"))
            named_files.write(named.unionByName(told), f"{self.root}/files")
            fs.create(done, False).close()
        return {"pages": pages, "sessions": sessions, "details": details, "agenda": agenda, "documents": documents, "manifests": manifests}
