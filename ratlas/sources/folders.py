"""Raw session folders, manifests and agenda summaries as tables."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratlas import schemas
from ratlas.functions import dates, text
from ratlas.functions.jsonx import member_list
from ratlas.sources import shared

#: Files that make a folder a session's.
MARKERS = ("manifest.json", "agenda_summary.json", "session_detail.html")
MARKER_FOLDERS = ("agenda", "session-documents")
_DOC = "title string, category string, agenda_item string, url string, path string, sha1 string, content_type string, content_disposition string, content_length bigint, etag string, last_modified string, retrieved_at string"
_ITEM = "number string, title string, reporter string, status string, decision string, documents_present boolean"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with the columns of a schema; a missing table is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return schemas.empty(spark, schema)
    return schemas.conform(spark.read.parquet(path), schema)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that must be there: FileNotFoundError if it is missing, ValueError if its files can't be read as one
    or lack a column of the schema. Only footers are read for that."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"no index at {path}")
    try:
        df = spark.read.option("mergeSchema", True).parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"no readable index at {path}") from e
    if lost := [f.name for f in StructType.fromDDL(schema) if f.name not in df.columns]:
        raise ValueError(f"the index at {path} lacks {', '.join(lost)}")
    return schemas.conform(df, schema)


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, name, text of the marker files below root, for folders of the form date-committee-id."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(MARKERS) + "}").format("binaryFile").load(root)
    df = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "utf-8").alias("text"))
    return df.where(F.rlike(F.element_at(F.split("folder", "/"), -1), F.lit(text.FOLDER)))


def session_folders(files: DataFrame) -> DataFrame:
    """folder, date, committee (as stored), session_id of each folder, and its JSON texts (null where missing)."""
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("text"))).alias(n.split(".")[0])
    name = F.element_at(F.split("folder", "/"), -1)
    part = lambda i: F.regexp_extract(name, text.FOLDER, i)
    return files.groupBy("folder").agg(one("manifest.json"), one("agenda_summary.json")).select("folder", part(1).alias("date"), part(2).alias("committee"), part(3).alias("session_id"), "manifest", "agenda_summary")


def local_index(folders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, agenda items and documents of folders. Unreadable JSON counts as none.

    Two folders of one session give one row of sessions, from the later path, and the children of both.
    """
    meta = F.from_json("manifest", "session struct<meeting_name:string,location:string,detail_url:string>, retrieved_at string")
    year, month = dates.year_month(F.col("date"))
    rows = folders.withColumn("m", meta)
    sessions = rows.select("session_id", "folder", F.struct("date", year.alias("year"), month.alias("month"), "committee", F.col("m.session.meeting_name"), F.lit(None).cast("string").alias("start_time"), F.col("m.session.location"), F.col("m.session.detail_url"), F.col("folder").alias("session_path")).alias("s"))
    sessions = schemas.conform(sessions.groupBy("session_id").agg(F.max_by("s", "folder").alias("s")).select("session_id", "s.*"), schemas.SESSIONS)
    items = folders.select("session_id", "folder", F.posexplode(member_list(F.col("agenda_summary"), "agenda_items", _ITEM)).alias("place", "i"))
    agenda = items.select("session_id", "i.number", "i.title", "i.reporter", "i.status", "i.decision", F.coalesce(F.col("i.documents_present").cast("int"), F.lit(0)).alias("documents_present"), "folder", "place")
    docs = rows.select("session_id", "folder", "m.retrieved_at", F.posexplode(member_list(F.col("manifest"), "documents", _DOC)).alias("place", "d"))
    kind = text.document_type(F.col("d.title"), F.col("d.category"), F.col("d.content_type"), F.col("d.url"), F.col("d.path"))
    documents = docs.select(
        "session_id", "d.title", "d.category", kind.alias("document_type"), "d.agenda_item", "d.url", F.col("d.path").alias("local_path"), "d.sha1",
        F.coalesce("d.retrieved_at", "retrieved_at").alias("retrieved_at"), "d.content_type", "d.content_length", "folder", "place",
    )
    return sessions, agenda, documents


def _pinned(df: DataFrame, path: str) -> DataFrame:
    """df, written once and read from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(children: DataFrame, schema: str, *order: str) -> DataFrame:
    """Children with an id by their order, in the columns of a schema; equal rows in any order.

    Ids come from one sort by range, not one task. Children are written before ranges are cut, as cutting reads them one
    time more, and ranges before they are counted: planned anew, each reading would cut them in its own way. A row's place
    in its range is part of what is written, so nothing is dealt again for it.
    """
    where = shared.folder(children.sparkSession, "numbered")
    once = _pinned(children, f"{where}/children")
    parts = _pinned(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), f"{where}/ranges")
    parts = parts.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m") % F.lit(2**33)})  # how Spark makes them
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", before.alias("__before"))
    return schemas.conform(parts.join(F.broadcast(sums), "__p").withColumn("id", F.col("__before") + F.col("__i") + 1), schema)


def inventory(files: DataFrame) -> DataFrame:
    """Files, folders and bytes of a listing (path, length) in one row."""
    return files.agg(F.count("*").alias("files"), F.countDistinct(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("folders"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def session_folder_count(files: DataFrame, root: str) -> DataFrame:
    """One row with the number of session folders in a listing (path): folders two or three levels below root that hold
    a marker file or folder; below a session's own folder none is looked for."""
    names, folders = "|".join(re.escape(n) for n in MARKERS), "|".join(re.escape(n) for n in MARKER_FOLDERS)
    mark = f"(?:(?:{names})$|(?:{folders})/)"
    rest = files.where(F.startswith("path", F.lit(root + "/"))).select(F.substring("path", len(root) + 2, 2**30).alias("p"))
    found = lambda depth: F.regexp_extract("p", rf"^((?:[^/]+/){{{depth}}}){mark}", 1)
    near = rest.select(found(2).alias("f")).where("f <> ''").distinct()
    far = rest.select(found(3).alias("f")).where("f <> ''").distinct()
    inside = far.withColumn("up", F.regexp_extract("f", "^((?:[^/]+/){2})", 1)).join(near.select(F.col("f").alias("up")), "up", "left_anti").select("f")
    return near.union(inside).agg(F.count("*").alias("session_folders"))
