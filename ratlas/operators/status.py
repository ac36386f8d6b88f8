"""What is there: counts of tables, labels, and the state of the vector index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.operators import index

#: Labels of a snapshot.
MISSING, PRESENT = "fehlt", "vorhanden"


def count_label(count: Column, noun: str) -> Column:
    """'n Noun'; 'fehlt' for a table that is missing."""
    return F.when(count.isNull(), MISSING).otherwise(F.concat(count.cast("string"), F.lit(f" {noun}")))


def local_label(sessions: Column, documents: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat(n(sessions), F.lit(" Sitzungen / "), n(documents), F.lit(" Dokumente"))
    return F.when(sessions.isNull() & documents.isNull(), MISSING).otherwise(text)


def table_counts(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row with the number of rows of each table, null for one that is missing. All are counted in one job."""
    one = spark.range(1).select()
    for name, df in tables.items():
        one = one.join(df.agg(F.count("*").alias(name))) if df is not None else one.withColumn(name, F.lit(None).cast("long"))
    return one


def snapshot(spark: SparkSession, sessions: DataFrame | None, documents: DataFrame | None, online: DataFrame | None, folders: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """One row: what exists, counts, and their labels. folders has a row for each raw session folder."""
    n = table_counts(spark, {"local_session_count": sessions, "local_document_count": documents, "online_session_count": online, "raw_session_count": folders})
    c = F.col
    return n.select(
        (c("local_session_count").isNotNull() | c("local_document_count").isNotNull()).alias("local_index_exists"), c("online_session_count").isNotNull().alias("online_index_exists"),
        F.lit(vectors is not None).alias("vectors_exist"), c("raw_session_count").isNotNull().alias("raw_data_exists"), "raw_session_count", count_label(c("raw_session_count"), "Sitzungsordner").alias("raw_data_summary"),
        "local_session_count", "local_document_count", local_label(c("local_session_count"), c("local_document_count")).alias("local_index_summary"), "online_session_count",
        count_label(c("online_session_count"), "Sitzungen").alias("online_index_summary"), F.lit(MISSING if vectors is None else PRESENT).alias("vectors_summary"),
    )


def vector_status(spark: SparkSession, documents: DataFrame | None, vectors: DataFrame | None, key: str = "id", warned: bool = False) -> DataFrame:
    """One row: current, indexed, missing, orphaned, coverage_percent and status.

    status is missing_local_index without documents, else missing_vectors without vectors, else warning if reading them
    warned, else ok or needs_update. What can't be counted is null; without vectors indexed is 0.
    """
    if documents is None or vectors is None:
        n = table_counts(spark, {"current": documents, "indexed": vectors})
        indexed = F.lit(0).cast("long") if vectors is None else F.col("indexed")
        gone = [F.lit(None).cast(t).alias(c) for c, t in (("missing", "long"), ("orphaned", "long"), ("coverage_percent", "double"))]
        return n.select("current", indexed.alias("indexed"), *gone, F.lit("missing_local_index" if documents is None else "missing_vectors").alias("status"))
    n = index.coverage(documents, vectors, key)
    return n.select("current", "indexed", "missing", "orphaned", "coverage_percent", F.lit("warning").alias("status") if warned else F.col("status"))
