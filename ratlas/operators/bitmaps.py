"""Coverage of an index without reading it again: bitmaps of ids a batch, merged by OR, compared by AND.

Each batch leaves, for either side, a bitmap a range of 32,768 ids. Counting what is current, indexed or both reads these
alone: some 4 KB a range that has ids, whatever the tables hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.operators.index import with_coverage
from ratlas.sources.shared import path_of

#: The two sides that are compared.
SIDES = ("current", "indexed")
_SCHEMA = "range bigint, bits binary, side string, batch bigint"


def of_ids(ids: DataFrame, key: str) -> DataFrame:
    """range and bits of the whole-number ids of a table; null ids have none. Tasks build bitmaps of their own rows, so what
    is shuffled is one row a range and task."""
    known = ids.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(key).alias("range"), F.bitmap_bit_position(key).alias("place"))
    return known.groupBy("range").agg(F.bitmap_construct_agg("place").alias("bits"))


@dataclass(frozen=True)
class Coverage:
    """Bitmaps below path: side=current or indexed, batch=N. A batch that is added again takes its own place, so it counts
    once. Ids are only added; after deletions a side is started anew with replace()."""

    spark: SparkSession
    path: str

    def add(self, side: str, ids: DataFrame, key: str, batch: int) -> None:
        if side not in SIDES:
            raise ValueError(f"side must be one of {SIDES}")
        of_ids(ids, key).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/side={side}/batch={batch}")

    def replace(self, side: str, ids: DataFrame, key: str, batch: int) -> None:
        """A side as of a batch, without all earlier ones."""
        self.add(side, ids, key, batch)
        fs, where = path_of(self.spark, f"{self.path}/side={side}")
        for x in fs.listStatus(where):
            if x.getPath().getName().startswith("batch=") and x.getPath().getName() != f"batch={batch}":
                fs.delete(x.getPath(), True)

    def bits(self) -> DataFrame:
        """side, range, bits over all batches."""
        fs, where = path_of(self.spark, self.path)
        if not fs.exists(where):
            return self.spark.createDataFrame([], "side string, range bigint, bits binary")
        df = self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(self.path)
        return df.groupBy("side", "range").agg(F.bitmap_or_agg("bits").alias("bits"))

    def coverage(self) -> DataFrame:
        """The row of index.coverage. A range counts as matched by the AND of both sides' bitmaps."""
        n = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.bitmap_count("bits"))), F.lit(0))
        merged = self.bits()
        per = merged.groupBy("range").agg(n("current").alias("c"), n("indexed").alias("i"), F.count("*").alias("sides"), F.bitmap_and_agg("bits").alias("both"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        one = per.agg(total("c").alias("current"), total("i").alias("indexed"), total(F.when(F.col("sides") == 2, F.bitmap_count("both"))).alias("matched"))
        there = merged.where("side = 'indexed'").agg(F.count("*").alias("n"))
        return with_coverage(one, there.select(F.col("n") == 0).scalar())
