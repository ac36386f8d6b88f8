"""Folders that driver and executors share, for indexes that a query builds."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may do without: it makes a folder and sets it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="ratlas-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    fs, where = path_of(spark, f"{root(spark)}/ratlas/{name}-{uuid.uuid4().hex}")
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return where.toString()


def write_dealt(df: DataFrame, path: str, by: str, mode: str = "error") -> None:
    """A Parquet table with a folder for each value of a column, and its schema, so that it can be read without rows."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(by).parquet(path)
    fs, where = path_of(df.sparkSession, f"{path}/_schema.json")  # readers of Parquet pass over such names
    out = fs.create(where, True)
    out.write(df.schema.json().encode())
    out.close()


def read_dealt(spark: SparkSession, path: str) -> DataFrame:
    """What write_dealt wrote."""
    fs, where = path_of(spark, f"{path}/_schema.json")
    stream = fs.open(where)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.schema(StructType.fromJson(json.loads(text))).parquet(path)
