"""Vectors in cells around centroids, and exact nearest neighbours by the triangle inequality.

On the unit sphere the largest cosine is the smallest distance. A vector lies in the cell of its nearest centroid and
knows its distance to it. With a score that k vectors reach, a search leaves out cells that lie too far away as a whole,
and in the others the rings whose distance to the centroid proves that they can't come nearer. No hit is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.operators.vectors import cosine, top
from ratlas.sources.shared import read_dealt, write_dealt

#: Vectors that centroids are fitted on at most, rounds of the fit, and what distances may be off by.
SAMPLE, ROUNDS, SLACK = 20_000, 8, 1e-6
#: Folder of vectors that have no direction: null, zero, not finite, or of another length.
NO_CELL = -1


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)  # so that no square overflows
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _usable(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and their unit vectors as a matrix."""
    lengths = np.diff(lists.offsets.to_numpy())
    use = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths == size)
    m = lists.filter(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, size)
    ok = np.isfinite(m).all(1) & m.any(1)
    use[np.flatnonzero(use)[~ok]] = False
    return use, _unit(m[ok])


def fit(vectors: DataFrame, cells: int, key: str = "id", dense: str = "dense", sample: int = SAMPLE) -> np.ndarray:
    """Centroids of the usable vectors of the most frequent length among `sample` vectors, drawn by the hash of their keys;
    cells of them at most. They only decide where vectors lie, never what a search finds."""
    drawn = vectors.where(F.col(dense).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(dense).toArrow().column(0).combine_chunks()
    if not len(drawn):
        return np.zeros((0, 0))
    lengths = np.diff(drawn.offsets.to_numpy())
    size = int(np.bincount(lengths).argmax())
    m = _usable(drawn, size)[1] if size else np.zeros((0, 0))
    if not len(m):
        return np.zeros((0, size))
    centers = m[np.random.default_rng(0).permutation(len(m))[:cells]]
    for _ in range(ROUNDS):
        near = (m @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, m)
        kept = sums.any(1)
        centers = _unit(sums[kept])
    return centers


def _place(centers: np.ndarray, names: list[str], dense: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, NO_CELL), np.zeros(batch.num_rows)
            if len(centers):
                use, m = _usable(batch.column(dense), centers.shape[1])
                likeness = m @ centers.T
                cell[use] = likeness.argmax(1)
                far[use] = np.linalg.norm(m - centers[cell[use]], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(far), pa.array(cell, pa.int32())], names=[*names, "far", "cell"])

    return run


@dataclass(frozen=True)
class Cells:
    """An index below path: cell=N folders of vectors with their distance to the centroid (far), and the cells' own table."""

    spark: SparkSession
    path: str
    key: str = "id"
    dense: str = "dense"

    def build(self, vectors: DataFrame, cells: int = 64, sample: int = SAMPLE, parts: int | None = None) -> None:
        """Write all rows and columns of vectors; the sample only fits centroids. A cell is spread over several tasks by
        distance, so a crowded one is no task's alone."""
        centers = fit(vectors, cells, self.key, self.dense, sample)
        schema = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
        placed = vectors.mapInArrow(_place(centers, vectors.columns, self.dense), f"{schema}, far double, cell int")
        order = ["cell", "far"]
        dealt = placed.repartitionByRange(parts, *order) if parts else placed.repartitionByRange(*order)
        write_dealt(dealt.sortWithinPartitions(*order), f"{self.path}/vectors", "cell")
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
        sizes = self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        known.join(sizes, "cell").coalesce(1).write.parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        return read_dealt(self.spark, f"{self.path}/vectors")

    def _distances(self, query: Sequence[float]) -> list[tuple[float, float, int, int]]:
        """(distance of the query to the centroid, radius, cell, n) of each cell, the nearest first."""
        q = np.array(query, "f8")
        known = self.spark.read.parquet(f"{self.path}/cells").collect()
        if not known or len(q) != len(known[0]["center"]) or not np.isfinite(q).all() or not q.any():
            return []
        q = _unit(q[None])[0]
        return sorted((float(np.linalg.norm(q - np.array(r["center"]))), r["radius"], r["cell"], r["n"]) for r in known)

    def reach(self, query: Sequence[float], k: int, where: Column | None = None) -> tuple[DataFrame, list[int]]:
        """The rows that may be among the k nearest, and the cells that hold them. The nearest cells are read first, until
        they have k vectors that pass the filter; the distance of the k-th bounds all others."""
        near, rows = self._distances(query), self.rows()
        rows = rows.where(where) if where is not None else rows
        asked, bound = [], None
        while bound is None and len(asked) < len(near):  # cells are doubled, so this takes few rounds
            asked = near[: max(1, 2 * len(asked))]
            some = rows.where(F.col("cell").isin(*[c for _, _, c, _ in asked]))
            found = top(cosine(some, query, self.key, self.dense), k, self.key).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
            if found["n"] >= k:
                bound = float(np.sqrt(max(0.0, 2 - 2 * found["low"]))) + SLACK
        if bound is None:
            return rows.where(F.col("cell") != NO_CELL) if near else rows.limit(0), [c for _, _, c, _ in near]
        open_ = [(d, c) for d, radius, c, _ in near if d - radius <= bound]
        ring = F.lit(False)
        for d, c in open_:
            ring = ring | ((F.col("cell") == c) & (F.col("far") >= d - bound) & (F.col("far") <= d + bound))
        return rows.where(F.col("cell").isin(*[c for _, c in open_]) & ring), [c for _, c in open_]

    def search(self, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """key and score (cosine) of the k nearest vectors that pass a filter, ties by key: the rows of a scan. A query that
        is zero, not finite, or of another length than the centroids finds nothing."""
        rows, _ = self.reach(query, k, where)
        return top(cosine(rows, query, self.key, self.dense), k, self.key)

    def stats(self, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """One row: cells and vectors of the index, cells read, and vectors compared."""
        rows, read = self.reach(query, k, where)
        known = self.spark.read.parquet(f"{self.path}/cells").agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"))
        return known.join(rows.agg(F.count("*").alias("vectors_compared"))).withColumn("cells_read", F.lit(len(read)).cast("long"))
