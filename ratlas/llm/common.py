"""What several operators share: the word definition, scratch tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as characters and as a class of Java and RE2.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="ratlas-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one run below the shared folder. They cut lineage: a lost executor costs only the tasks that it ran.

    Operators drop a table as soon as later ones are written. What their results still read goes with release(), or else
    when the driver ends, as the file system is told at the start.
    """

    _open: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/ratlas/{name}-{uuid.uuid4().hex}"
        fs, path = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Scratch._open[self.path] = self

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, or all of this run."""
        for name in names or ("",):
            fs, path = self._at(name)
            fs.delete(path, True)
        if not names:
            Scratch._open.pop(self.path, None)


def release() -> None:
    """Delete the scratch tables of all runs of this session. DataFrames that operators returned can't be read after."""
    for scratch in list(Scratch._open.values()):
        scratch.drop()


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def count_words(text: Column) -> Column:
    """Number of words as long, by built-in functions; null or blank: 0."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+"))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of a column stay near so many bytes; rows are never split."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def strings(column: pa.Array) -> pa.Array:
    """A string column with large offsets and without nulls, copied: Arrow's string functions misread slices."""
    import numpy as np

    return pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(np.arange(len(column))))


def split_words(text: pa.Array) -> tuple[pa.Array, list]:
    """The words of all texts in a row, and how many each text has. Words never contain SPACE."""
    import numpy as np

    parts = pc.ascii_split_whitespace(text)
    offsets = parts.offsets.to_numpy()
    flat = parts.values
    if offsets[0] or offsets[-1] != len(flat):
        flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)) if not real.all() else flat, np.diff(total[offsets])
