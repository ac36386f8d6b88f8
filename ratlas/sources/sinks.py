"""Files for people and other programs: manifests, summaries, exports and given texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.functions import text


def manifests(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """session_id and the manifest of each session as JSON: the session, retrieved_at and its documents by address."""
    entry = [c for c in ("title", "category", "agenda_item", "url", "path", "sha1", "content_type", "content_disposition", "content_length", "etag", "last_modified") if c in documents.columns]
    docs = documents.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("url", *[c for c in entry if c != "url"]))).alias("documents"))
    s = F.struct(F.col("session_id").alias("id"), *[c for c in ("committee", "meeting_name", "date", "detail_url", "location") if c in sessions.columns])
    return sessions.join(docs, "session_id", "left").select("session_id", F.to_json(F.struct(s.alias("session"), "retrieved_at", F.coalesce("documents", F.expr("array()")).alias("documents"))).alias("value"))


def agenda_summaries(sessions: DataFrame, agenda: DataFrame, generated_at: str) -> DataFrame:
    """session_id and the summary of each session as JSON: its agenda items in order, with decision and a flag for
    documents."""
    item = F.struct("id", "number", "title", "reporter", "status", text.decision(F.col("status")).alias("decision"), (F.col("documents_present") == 1).alias("documents_present"))
    rows = agenda.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("i"))
    items = F.transform(F.coalesce("i", F.expr("array()")), lambda x: F.struct(*[x[c].alias(c) for c in ("number", "title", "reporter", "status", "decision", "documents_present")]))
    s = F.struct(F.col("session_id").alias("id"), "committee", "meeting_name", "date")
    return sessions.join(rows, "session_id", "left").select("session_id", F.to_json(F.struct(s.alias("session"), F.lit(generated_at).alias("generated_at"), items.alias("agenda_items"))).alias("value"))


def write_text(spark: SparkSession, path: str, content: str) -> str:
    """Write a text file from the driver to any file system without replacing one: name.ext, name.1.ext, name.2.ext.
    Returns the path; the content ends in one line feed."""
    jvm = spark._jvm
    stem, dot, ext = path.rpartition(".")
    if "/" in ext or not dot:
        stem, ext = path, ""
    n = 0
    while True:
        name = f"{stem}{f'.{n}' if n else ''}{f'.{ext}' if ext else ''}"
        where = jvm.org.apache.hadoop.fs.Path(name)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            break
        n += 1
    out = fs.create(where, False)
    out.write(bytearray((content.rstrip() + "\n").encode()))
    out.close()
    return name


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a text file in place of one: readers see the old or the new content, as the new file is renamed over it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    where = hadoop.Path(path)
    new = hadoop.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = where.getFileSystem(conf).create(new, False)
    out.write(bytearray(content.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf)
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(where), over)


def write_values(df: DataFrame, path: str) -> None:
    """One JSON text a line, in as many files as there are partitions."""
    df.select("value").write.text(path)
