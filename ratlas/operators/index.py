"""Keeping an index current: refresh decisions, upserts, child replacement, type backfill, vector coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratlas.functions import text, urls
from ratlas.functions.text import as_text


def incomplete(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids of sessions without documents, with the meaning of NOT IN: a null among the documents' ids leaves none, a null
    session is in only if there are no documents.

    Whether there are documents, and nulls among them, is one row that a scalar subquery reads; the ids then meet in a
    plain anti join, which Spark shuffles or broadcasts by their size. NOT IN itself would broadcast all of them.
    """
    key = F.col("session_id")
    ids = documents.select("session_id")
    known = ids.agg(F.struct(F.count("*").alias("rows"), F.count_if(key.isNull()).alias("nulls")).alias("n")).scalar()
    left = sessions.select("session_id").join(ids.where(key.isNotNull()), "session_id", "left_anti").withColumn("__n", known)
    return left.where((F.col("__n.rows") == 0) | ((F.col("__n.nulls") == 0) & key.isNotNull())).select("session_id")


def to_refresh(new: DataFrame, sessions: DataFrame, documents: DataFrame, refresh_existing: bool = False, only_refresh: bool = False) -> DataFrame:
    """The new rows that a build takes: unknown sessions (not with only_refresh), known ones if refreshing or incomplete."""
    known = sessions.select("session_id").distinct().withColumn("__known", F.lit(True))
    short = incomplete(sessions, documents).distinct().withColumn("__short", F.lit(True))
    df = new.join(known, "session_id", "left").join(short, "session_id", "left")
    take = F.when(F.col("__known"), F.lit(refresh_existing or only_refresh) | F.coalesce("__short", F.lit(False))).otherwise(F.lit(not only_refresh))
    return df.where(take).drop("__known", "__short")


def upsert(base: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """base with the rows of new in place of those with their key; of several new ones the last by order (null: before
    all others), ties by the other columns, so that reruns agree."""
    first = [order] if order else []
    rest = [c for c in new.columns if c not in (key, order)]
    if first or rest:
        new = new.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("__r")).select(key, "__r.*")
    else:
        new = new.distinct()
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*[c for c in base.columns if c in new.columns]), allowMissingColumns=True)


def replace_children(base: DataFrame, new: DataFrame, refreshed: DataFrame, key: str = "session_id") -> DataFrame:
    """base without the children of refreshed keys, and the new ones."""
    return base.join(refreshed.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def backfill_types(documents: DataFrame) -> DataFrame:
    """Documents whose blank type is inferred; the older name 'niederschrift' becomes 'protokoll'."""
    kind = F.col("document_type")
    found = text.document_type(*[F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in ("title", "category", "content_type", "url", "local_path")])
    blank = F.btrim(as_text(kind)) == ""
    return documents.withColumn("document_type", F.when(F.lower(F.btrim(kind)) == "niederschrift", "protokoll").when(blank, found).otherwise(kind))


def stable_ids(documents: DataFrame) -> DataFrame:
    return documents.withColumn("stable_id", urls.stable_id(F.col("session_id"), F.col("url"), F.col("agenda_item")))


def id_collisions(documents: DataFrame) -> DataFrame:
    """One row: rows, distinct stable ids, and their difference."""
    n = stable_ids(documents).agg(F.count("*").alias("rows"), F.countDistinct("stable_id").alias("ids"))
    return n.withColumn("collisions", F.col("rows") - F.col("ids"))


def missing(current: DataFrame, indexed: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows of current that aren't indexed, in the order of their key; a limit counts after that."""
    df = current.join(indexed.select(key), key, "left_anti")
    return df.orderBy(key).limit(limit) if limit is not None else df


def orphans(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Indexed keys that are no longer current."""
    return indexed.select(key).distinct().join(current.select(key), key, "left_anti")


def coverage(current: DataFrame, indexed: DataFrame | None, key: str) -> DataFrame:
    """One row: current, indexed, matched, missing, orphaned, coverage_percent (half-even, 100 for none) and status.

    indexed is None where there is no index: then the status is missing_index.
    """
    sides = current.select(key, F.lit(1).alias("c"), F.lit(0).alias("i"))
    sides = sides.unionAll(indexed.select(key, F.lit(0), F.lit(1))) if indexed is not None else sides
    each = sides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("c").alias("c"), F.max("i").alias("i"))  # a task holds one table of keys
    n = each.agg(F.count_if(F.col("c") == 1).alias("current"), F.count_if(F.col("i") == 1).alias("indexed"), F.count_if(F.col("c") + F.col("i") == 2).alias("matched"))
    return with_coverage(n, F.lit(indexed is None))


def with_coverage(n: DataFrame, no_index: Column) -> DataFrame:
    """A row of current, indexed and matched with missing, orphaned, coverage_percent and status."""
    n = n.withColumn("missing", F.col("current") - F.col("matched")).withColumn("orphaned", F.col("indexed") - F.col("matched"))
    n = n.withColumn("coverage_percent", F.when(F.col("current") == 0, 100.0).otherwise(F.bround(F.col("matched") * 100.0 / F.col("current"), 1).cast("double")))
    status = F.when(no_index, "missing_index").when((F.col("missing") > 0) | (F.col("orphaned") > 0), "needs_update").otherwise("ok")
    return n.withColumn("status", status)


def latest_dates(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: the latest date of a session, and of a session that has documents."""
    s = sessions.agg(F.max("date").alias("latest_session"))
    with_docs = sessions.where("date IS NOT NULL AND trim(date) <> ''").join(documents.select("session_id"), "session_id", "left_semi")
    return s.join(with_docs.agg(F.max("date").alias("latest_document")))


def match_manifest(documents: DataFrame, entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the stored entry (path, etag, ...) of the same address, item, title and category, nulls equal;
    of several entries the first by `place`. by: further keys, as session_id where entries of several manifests meet."""
    keys = [*by, "url", "agenda_item", "title", "category"]
    rest = [c for c in entries.columns if c not in keys]
    # structs are equal where their nulls are; by one key, what the grouping dealt needn't be dealt again for the join
    first = entries.groupBy(F.struct(*keys).alias("__k")).agg(F.min_by(F.struct(*rest), "place").alias("entry"))
    return documents.join(first, F.struct(*keys) == F.col("__k"), "left").drop("__k")
