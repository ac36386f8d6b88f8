"""Council-shaped tables over the star schema, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS_SQL = """
sessions AS (
  SELECT o_orderkey::VARCHAR AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
         o_orderpriority AS committee, 'Sitzung ' || o_orderstatus AS meeting_name, 'si0057.asp?__ksinr=' || o_orderkey AS detail_url,
         'data/raw/' || strftime(o_orderdate, '%Y/%m') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || replace(o_orderpriority, ' ', '-') || '-' || o_orderkey AS session_path
  FROM orders)"""
AGENDA_SQL = """
agenda AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey::VARCHAR AS session_id, 'Ö ' || l_linenumber AS number,
         p_name AS title, CASE l_returnflag WHEN 'A' THEN 'beschlossen' WHEN 'R' THEN 'vertagt' ELSE 'in Vorbereitung' END AS status
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O')"""
DOCUMENTS_SQL = """
docs AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey::VARCHAR AS session_id, p_name AS title, p_brand AS category,
         CASE WHEN p_size % 5 = 0 THEN 'protokoll' WHEN p_size % 5 = 1 THEN 'vorlage' WHEN p_size % 5 = 2 THEN 'beschlussvorlage' WHEN p_size % 5 = 3 THEN 'sonstiges' END AS document_type,
         CASE WHEN l_returnflag <> 'N' THEN 'Ö ' || l_linenumber END AS agenda_item, 'getfile.asp?id=' || l_partkey || '&type=do' AS url,
         CASE WHEN l_returnflag = 'R' THEN '' ELSE 'agenda/' || l_suppkey || '.pdf' END AS local_path, 'application/pdf' AS content_type
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    path = F.concat(F.lit("data/raw/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/"), day, F.lit("-"), F.replace("o_orderpriority", F.lit(" "), F.lit("-")), F.lit("-"), key)
    return load(spark, sf_dir, "orders").select(
        key.alias("session_id"), day.alias("date"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("committee"),
        F.concat(F.lit("Sitzung "), F.col("o_orderstatus")).alias("meeting_name"), F.concat(F.lit("si0057.asp?__ksinr="), key).alias("detail_url"), path.alias("session_path"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).withColumn("id", number * 10_000 + F.col("l_suppkey")).withColumn("session_id", F.col("l_orderkey").cast("string")).withColumn("top", F.concat(F.lit("Ö "), F.col("l_linenumber").cast("string")))


def agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "beschlossen").when(flag == "R", "vertagt").otherwise("in Vorbereitung")
    return _lines(spark, sf_dir).where("l_linestatus = 'O'").select("id", "session_id", F.col("top").alias("number"), F.col("p_name").alias("title"), status.alias("status"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 5
    kind = F.when(m == 0, "protokoll").when(m == 1, "vorlage").when(m == 2, "beschlussvorlage").when(m == 3, "sonstiges")
    return _lines(spark, sf_dir).select(
        "id", "session_id", F.col("p_name").alias("title"), F.col("p_brand").alias("category"), kind.alias("document_type"), F.when(F.col("l_returnflag") != "N", F.col("top")).alias("agenda_item"),
        F.concat(F.lit("getfile.asp?id="), F.col("l_partkey").cast("string"), F.lit("&type=do")).alias("url"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("agenda/"), F.col("l_suppkey").cast("string"), F.lit(".pdf"))).alias("local_path"), F.lit("application/pdf").alias("content_type"),
    )
