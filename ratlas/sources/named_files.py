"""A sink of named files in two phases: df.write.format("ratlas_files") with columns name and content.

Tasks write contents to a staging folder under names of their own; the commit gives the files of successful attempts their
names. A name that is taken gets .1, .2 and so on before its last dot: nothing is ever replaced. Contents never pass through
the driver, which only links names. What a failed attempt or job has staged is not visible and is deleted.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ratlas.sources.sqlite import local


@dataclass
class Contents(WriterCommitMessage):
    """A task's folder, and the names of the files 0, 1 and so on in it."""

    folder: str
    names: list[str] = field(default_factory=list)


def numbered(name: str, n: int) -> str:
    """The n-th name in place of one that is taken; a folder's dots don't count."""
    head, slash, last = name.rpartition("/")
    stem, dot, ext = last.rpartition(".")
    last = (f"{stem}.{n}.{ext}" if dot and stem else f"{last}.{n}") if n else last
    return head + slash + last


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = local(options["path"]).rstrip("/")
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)  # made here alone, so that a task that outlives an aborted job finds no place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Contents:
        out = Contents(f"{self.staging}/{uuid.uuid4().hex}")
        os.mkdir(out.folder)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                parts = (name or "").split("/")
                if not name or name.startswith("/") or ".." in parts or "" in parts or parts[0].startswith("_staging-"):
                    raise ValueError(f"no name below the folder: {name!r}")
                with open(f"{out.folder}/{len(out.names)}", "xb") as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
                out.names.append(name)
        return out

    def commit(self, messages) -> None:
        made: set[str] = set()
        following: dict[str, int] = {}  # the number after those that this commit has seen taken, by name
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.names):
            for i, name in enumerate(m.names):
                if (where := os.path.dirname(f"{self.root}/{name}")) not in made:
                    os.makedirs(where, exist_ok=True)
                    made.add(where)
                n = following.get(name, 0)
                while True:
                    try:
                        os.link(f"{m.folder}/{i}", f"{self.root}/{numbered(name, n)}")  # fails where the name is taken
                        break
                    except FileExistsError:
                        n += 1
                following[name] = n + 1
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FilesSink(DataSource):
    """Option: path. Columns: name (below the folder, no '..'), content (string or binary; null is empty)."""

    @classmethod
    def name(cls) -> str:
        return "ratlas_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite or {x.name for x in schema} != {"name", "content"}:
            raise ValueError("files are only added, from the columns name and content")
        return Writer(self.options)


def write(files: DataFrame, root: str) -> None:
    """files (name, content) below root."""
    files.sparkSession.dataSource.register(FilesSink)
    files.select("name", "content").write.format("ratlas_files").mode("append").option("path", root).save()
