"""States of analysis jobs as a stream: the latest event of each job, and a timer for jobs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ratlas.sources.keyed import KeyedTable

#: Events and states alike; stalled says that a job which waits or runs has had no event for too long.
EVENTS = "job_id string, at timestamp, status string, error_message string"
STATES = f"{EVENTS}, stalled boolean"
ACTIVE = ("queued", "running")
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    """Keeps the latest event of a job by time, status and message, as current_states orders them. A job that waits or runs
    has a timer, which its next event puts off."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, status string, error_message string")

    @staticmethod
    def _row(key, last, stalled: bool) -> pd.DataFrame:
        at, status, error = last
        return pd.DataFrame({"job_id": [key[0]], "at": [pd.Timestamp(at, unit="us")], "status": [status], "error_message": [error], "stalled": [stalled]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        old = tuple(self.last.get()) if self.last.exists() else None
        order = lambda x: tuple((v is not None, v if v is not None else "") for v in x[1:])  # noqa: E731  (nulls before others)
        new = old
        for part in rows:
            for at, status, error in zip(part["at"].astype("datetime64[us]").astype("int64").tolist(), part["status"].tolist(), part["error_message"].tolist(), strict=True):
                one = (at, status, error)
                if new is None or (one[0], order(one)) > (new[0], order(new)):
                    new = one
        if new != old:
            self.last.update(new)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if new[1] in ACTIVE:
                self.handle.registerTimer(new[0] // 1000 + self.silence_ms)
            yield self._row(key, new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.last.exists() and (last := tuple(self.last.get()))[1] in ACTIVE:
            yield self._row(key, last, True)


def states(events: DataFrame, silence: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of changed states (STATES) from a stream of events (EVENTS). silence: for how long, by the events' own time,
    an active job may say nothing before it counts as stalled; late: by how much events may come out of order: what is
    later than that when a batch begins is left out, as Spark does. Events without job or time have no state."""
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    known = events.where("job_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return known.groupBy("job_id").transformWithStateInPandas(Latest(ms), STATES, "update", "eventTime")


def follow(spark: SparkSession, landing: str, target: str, checkpoint: str, silence: str = "1 hour", late: str = "10 minutes", files: int = 1) -> StreamingQuery:
    """Take what the landing folder holds, files at a time, into a keyed table of states, and stop. A batch is one commit, so
    one that runs again after a failure counts once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    table = KeyedTable(spark, target, STATES, "job_id")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(landing)

    def put(batch: DataFrame, number: int) -> None:
        order = F.struct("at", F.col("stalled").cast("int"), "status", "error_message")
        batch = batch.persist()  # a commit reads its rows more than once, and state must not be asked twice
        last = batch.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "job_id"]), order).alias("s")).select("job_id", "s.*")
        KeyedTable(batch.sparkSession, table.path, table.schema, table.key).apply(last, writer=checkpoint, batch=number)
        batch.unpersist()

    return states(events, silence, late).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
