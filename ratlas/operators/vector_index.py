"""Building the vector index: documents with their sessions, payloads, what is missing, what is orphaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratlas.functions.text import as_text
from ratlas.operators import index
from ratlas.operators.sessions import source_availability

#: The fields of a payload in their order.
PAYLOAD = ("session_id", "title", "document_type", "agenda_item", "url", "local_path", "date", "committee")


def documents_for_index(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Documents with date and committee of their session, where it is known."""
    own = documents.drop("date", "committee", "session_path")
    return own.join(sessions.select("session_id", "date", "committee", "session_path"), "session_id", "left")


def payloads(documents: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """id and a payload of eight fields, null as empty text but for session_id; local_path is the file's path, or empty
    where the listing (path) doesn't have it."""
    df = source_availability(documents.drop("date", "committee", "session_path"), sessions, files, "date", "committee")
    path = F.concat_ws("/", F.nullif(F.rtrim(as_text(F.col("session_path")), F.lit("/")), F.lit("")), F.col("local_path"))
    value = {"session_id": F.col("session_id"), "local_path": F.when(F.col("source_available"), path).otherwise("")}
    return df.select("id", F.struct(*[value.get(c, as_text(F.col(c))).alias(c) for c in PAYLOAD]).alias("payload"))


def build(documents: DataFrame, vectors: DataFrame, vectorize, limit: int | None = None, key: str = "id") -> DataFrame:
    """The vectors (key and others) after a build: what lacks a vector gets one by vectorize(DataFrame) -> DataFrame.

    With a limit only the first so many by key are taken and nothing is deleted; a full build drops the vectors whose
    documents are gone. Of documents that share a key the last by their other columns counts. vectorize runs where the
    rows are, in Arrow batches of the session's size, and sees each new document once: what it gives has keys that the
    kept vectors lack, so it is only added to them.
    """
    rest = [c for c in documents.columns if c != key]
    one = documents.groupBy(key).agg(F.max(F.struct(*rest)).alias("__r")).select(key, "__r.*").select(*documents.columns) if rest else documents.distinct()
    new = vectorize(index.missing(one, vectors, key, limit))
    kept = vectors if limit is not None else vectors.join(documents.select(key), key, "left_semi")
    return kept.unionByName(new.select(*[c for c in vectors.columns if c in new.columns]), allowMissingColumns=True)


def delete(vectors: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Vectors without those of the given keys."""
    return vectors.join(keys.select(key), key, "left_anti")


def searchable(source: str, has_vectors: Column) -> Column:
    """Whether hybrid search is offered: only the local index has vectors."""
    return F.lit(source == "local") & has_vectors
