"""The index as a stream over a landing table: each micro-batch is one commit of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ratlas.sources.keyed import KeyedTable


def upsert_batch(table: KeyedTable, order: str, writer: str = "stream"):
    """A function for foreachBatch: the last row of each key by order is committed. The batch's number is committed with
    it, so a batch that runs again after a failure counts once; what is written follows the batch, not the index."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            KeyedTable(batch.sparkSession, table.path, table.schema, table.key).upsert(batch, order, writer=writer, batch=number)

    return run


def index_stream(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: str = "session_id", order: str = "retrieved_at") -> StreamingQuery:
    """Take what the landing folder holds into the table at target, and stop; schema must have key and order."""
    rows = spark.readStream.schema(schema).parquet(landing)
    put = upsert_batch(KeyedTable(spark, target, schema, key), order, checkpoint)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
