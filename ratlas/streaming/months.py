"""Sessions of month pages as a stream: a session that several months show comes once, from the first page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ratlas.sources import html_tables
from ratlas.sources.keyed import KeyedTable
from ratlas.streaming.job_states import STORE

PAGES = "page_id bigint, year int, month int, html string, retrieved_at timestamp"
SESSIONS = "session_id string, page_id bigint, place int, committee string, meeting_name string, date string, start_time string, detail_url string, location string, retrieved_at timestamp"
_ORDER = ["page_id", "place"]


class First(StatefulProcessor):
    """Lets the first row of a session through and remembers it until the horizon has passed; then the session is new."""

    def __init__(self, horizon_ms: int, columns: list[str]):
        self.horizon_ms, self.columns = horizon_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "page_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.seen.exists():
            for _ in rows:
                pass
            return
        best = None
        for part in rows:
            one = part.sort_values(_ORDER).head(1)
            if best is None or tuple(one[_ORDER].iloc[0]) < tuple(best[_ORDER].iloc[0]):
                best = one
        self.seen.update((int(best["page_id"].iloc[0]),))
        self.handle.registerTimer(int(best["retrieved_at"].iloc[0].timestamp() * 1000) + self.horizon_ms)
        yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.seen.clear()
        return iter([])


def first_sessions(pages: DataFrame, base: str, horizon: str = "62 days", late: str = "1 day") -> DataFrame:
    """A stream of sessions (SESSIONS) from a stream of month pages (PAGES). Of the pages of a batch the smallest page_id
    counts, of later batches none, until the horizon has passed by the pages' own time; state is bounded by what the pages
    of such a time show. Pages that are later than `late` when a batch begins are left out, as Spark does. Sessions without
    id or time have no row."""
    rows = html_tables.overview_sessions(pages, base, keep=("retrieved_at",)).where("session_id <> '' AND retrieved_at IS NOT NULL")
    columns = [c.split()[0] for c in SESSIONS.split(", ")]
    known = rows.select(*columns).withWatermark("retrieved_at", late)
    ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    return known.groupBy("session_id").transformWithStateInPandas(First(ms, columns), SESSIONS, "append", "eventTime")


def follow(spark: SparkSession, landing: str, target: str, checkpoint: str, base: str, horizon: str = "62 days", late: str = "1 day", files: int = 1) -> StreamingQuery:
    """Take what the landing folder holds, files at a time, into a keyed table of sessions, and stop."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(landing)

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a commit reads its rows more than once, and state must not be asked twice
        KeyedTable(batch.sparkSession, target, SESSIONS, "session_id").apply(batch, writer=checkpoint, batch=number)
        batch.unpersist()

    return first_sessions(pages, base, horizon, late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
