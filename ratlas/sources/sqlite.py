"""Stored indexes in SQLite files as a data source: spark.read.format("ratlas_sqlite") and df.write.format(...).

A store is one file, or a folder of files that each hold a part of the table. A scan has a task for each range of row
numbers, and conditions run inside the files. A write stages a file a task, and one rename of their folder makes them
visible. Files lie on a mount that driver and executors share, as SQLite opens files by itself.
"""

from __future__ import annotations

import os
import re
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a task, and of a batch that it hands on.
ROWS, BATCH = 100_000, 10_000
#: How a stored value is read as a type: values of other kinds count as null, as columns of SQLite hold any kind.
READ = {
    "string": "CASE WHEN typeof({c}) IN ('text', 'integer', 'real') THEN CAST({c} AS TEXT) END", "boolean": "CASE typeof({c}) WHEN 'integer' THEN {c} <> 0 END", "binary": "CASE typeof({c}) WHEN 'blob' THEN {c} END",
    "double": "CASE WHEN typeof({c}) IN ('integer', 'real') THEN CAST({c} AS REAL) END", "bigint": "CASE typeof({c}) WHEN 'integer' THEN {c} END", "int": "CASE WHEN typeof({c}) = 'integer' AND {c} BETWEEN -2147483648 AND 2147483647 THEN {c} END",
}
STORED = {"string": "TEXT", "boolean": "INTEGER", "binary": "BLOB", "double": "REAL", "bigint": "INTEGER", "int": "INTEGER"}
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local(path: str) -> str:
    """A path of the shared mount, without its scheme."""
    return re.sub("^file:(//)?(?=/)", "", path)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files_of(path: str) -> list[str]:
    """The files of a store: itself, or those in its folder whose names end in .sqlite or .db; none if it is missing."""
    where = local(path)
    if os.path.isdir(where):
        return sorted(os.path.join(where, n) for n in os.listdir(where) if n.endswith((".sqlite", ".db")))
    return [where] if os.path.isfile(where) else []


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


@dataclass(frozen=True)
class Rows(InputPartition):
    file: str
    first: int
    last: int


class Reader(DataSourceReader):
    """Rows of a table by ranges of rowid. A missing or broken file and a missing table have no rows; a missing column is
    null. Conditions are put to the same expressions that are read, so a file finds what Spark would."""

    def __init__(self, schema: StructType, options):
        self.schema, self.path, self.table = schema, options["path"], options.get("table", "rows")
        self.size = int(options.get("rows", ROWS))
        self.conditions: list[tuple[str, list]] = []

    def _sql(self, f: Filter, types: dict[str, str]) -> tuple[str, list] | None:
        """A condition as SQL over names in braces, with its values; None for what is left to Spark."""
        if isinstance(f, Not):
            inner = self._sql(f.child, types)
            return (f"NOT ({inner[0]})", inner[1]) if inner else None
        if len(f.attribute) != 1 or f.attribute[0] not in types:
            return None
        name = "{" + str(list(types).index(f.attribute[0])) + "}"
        kind = types[f.attribute[0]]
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
        text = {StringStartsWith: "substr({0}, 1, length(?)) = ?", StringEndsWith: "substr({0}, -length(?)) = ? AND length(?) > 0", StringContains: "instr({0}, ?) > 0"}.get(type(f))
        if text:
            return (text.replace("{0}", name), [f.value] * text.count("?")) if kind == "string" and f.value and "\0" not in f.value else None
        values = list(f.value) if isinstance(f, In) else [f.value]
        fits = {"string": str, "bigint": int, "int": int, "double": (int, float), "boolean": bool}.get(kind)
        if fits is None or not all(isinstance(v, fits) and (kind == "boolean" or not isinstance(v, bool)) and v == v and not (isinstance(v, str) and "\0" in v) for v in values):
            return None
        if isinstance(f, In):
            return f"{name} IN ({', '.join('?' * len(values))})", values
        if isinstance(f, EqualNullSafe):
            return f"{name} IS ?", values
        return (f"{name} {SIGNS[type(f)]} ?", values) if type(f) in SIGNS else None

    def pushFilters(self, filters: list[Filter]):
        types = {x.name: x.dataType.simpleString() for x in self.schema}
        for f in filters:
            if done := self._sql(f, types):
                self.conditions.append(done)
            else:
                yield f

    def partitions(self):
        out = []
        for file in files_of(self.path):
            try:
                con = opened(file)
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                con.close()
            except sqlite3.Error:
                continue
            if low is not None:
                out += [Rows(file, a, min(a + self.size - 1, high)) for a in range(low, high + 1, self.size)]
        return out or [Rows("", 0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        kinds = to_arrow_schema(self.schema)
        try:
            con = opened(partition.file)
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            there = {r[1] for r in con.execute(f"PRAGMA table_info({quoted(self.table)})")}
            columns = [READ[x.dataType.simpleString()].format(c=quoted(x.name)) if x.name in there else "NULL" for x in self.schema]
            where, values = ["rowid BETWEEN ? AND ?"], [partition.first, partition.last]
            for sql, more in self.conditions:
                where.append(f"({sql.format(*columns)})")
                values += more
            cursor = con.execute(f"SELECT {', '.join(columns) or '1'} FROM {quoted(self.table)} WHERE {' AND '.join(where)}", values)
            while rows := cursor.fetchmany(BATCH):
                columns_ = list(zip(*rows, strict=True))
                booleans = [x.dataType.simpleString() == "boolean" for x in self.schema]
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else bool(v) for v in c] if b else list(c), k.type) for c, k, b in zip(columns_, kinds, booleans, strict=True)], schema=kinds)
            con.close()
        except sqlite3.Error:
            return


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


class Writer(DataSourceArrowWriter):
    """A file for each task, staged beside the store. The commit leaves out what failed attempts have staged, and renames
    the folder; the store is then whole, or, if it doesn't come to that, as it was."""

    def __init__(self, schema: StructType, options, overwrite: bool):
        self.schema, self.path, self.table, self.overwrite = schema, local(options["path"]).rstrip("/"), options.get("table", "rows"), overwrite
        head, _, last = self.path.rpartition("/")
        self.staging = f"{head}/.{last}.{uuid.uuid4().hex}.staging"  # one for all tasks: Spark sends this object to them
        os.makedirs(self.staging)  # made here alone, so that a task that outlives an aborted job finds no place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        name, n = f"part-{uuid.uuid4().hex}.sqlite", 0
        con = sqlite3.connect(f"{self.staging}/{name}")
        con.execute("PRAGMA synchronous = OFF")
        columns = ", ".join(f"{quoted(x.name)} {STORED[x.dataType.simpleString()]}" for x in self.schema)
        con.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
        for batch in iterator:
            con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", zip(*[c.to_pylist() for c in batch.columns], strict=True))
            n += batch.num_rows
        con.commit()
        con.close()
        return Staged(name, n)

    def commit(self, messages) -> None:
        keep = {m.name for m in messages if m is not None}
        for n in os.listdir(self.staging):
            if n not in keep:
                os.remove(f"{self.staging}/{n}")
        if os.path.exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            old = f"{self.staging}.old"
            os.rename(self.path, old)
            os.rename(self.staging, self.path)
            shutil.rmtree(old, ignore_errors=True)
        else:
            os.rename(self.staging, self.path)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SqliteSource(DataSource):
    """Options: path, table (rows), rows (of a task). Reading needs a schema of strings, whole numbers, doubles, booleans or
    bytes."""

    @classmethod
    def name(cls) -> str:
        return "ratlas_sqlite"

    def schema(self):
        raise ValueError("name the columns by .schema(...): a table of SQLite may lack some, and holds values of any kind")

    def reader(self, schema: StructType) -> Reader:
        if bad := [x.name for x in schema if x.dataType.simpleString() not in READ]:
            raise ValueError(f"no such type in SQLite: {bad}")
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if bad := [x.name for x in schema if x.dataType.simpleString() not in STORED]:
            raise ValueError(f"no such type in SQLite: {bad}")
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, schema: str, rows: int = ROWS) -> DataFrame:
    """A table of a store with the columns of a schema; what is missing or broken has no rows."""
    register(spark)
    return spark.read.format("ratlas_sqlite").schema(schema).options(table=table, rows=rows).load(path)


def write(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """df as a store; mode 'append' asks that none is there, 'overwrite' replaces one."""
    register(df.sparkSession)
    df.write.format("ratlas_sqlite").mode(mode).options(path=path, table=table).save()
