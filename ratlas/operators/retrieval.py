"""Hybrid retrieval through stored indexes: the rows of vectors.hybrid, from cells and postings instead of scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from ratlas.operators import postings, vectors
from ratlas.operators.vector_cells import Cells


def hybrid(cells: Cells, path: str, query_vector: Sequence[float], query: Mapping[str, float] | Sequence[str], k: int = 10, where: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """The k best of both lists of 3 k, by ranks. path: the postings of the texts. A filter holds before anything is ranked:
    where for the vectors' own columns, among (id) for the texts, which must be those that where lets through."""
    dense = vectors.ranked(cells.search(query_vector, 3 * k, where), 3 * k)
    sparse = vectors.ranked(postings.search(cells.spark, path, query, 3 * k, among), 3 * k)
    return vectors.fuse([dense, sparse], k)
