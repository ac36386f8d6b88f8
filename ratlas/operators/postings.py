"""Postings of sparse vectors: a table dealt by term, and the best k by bounds of its blocks.

A term's postings lie in the order of their weights, in blocks that know their largest one. A search first adds up the
heaviest blocks of its terms, which gives a score that k documents reach. A block whose largest weight, with the largest
weights of all other terms, stays below that score holds no document of the result: whoever stands in it can't reach the
score. All other blocks are read, and what they hold of a document of the result is all that it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.operators.vectors import hashed_words, list_slices, sparse_query, top, weights_of_words
from ratlas.sources.shared import read_dealt, write_dealt

#: Folders of a table, postings of a block, and postings that a task gathers at a time.
BUCKETS, BLOCK, HELD = 64, 256, 1 << 19
#: Slack of comparisons with a bound: sums in another order differ in their last bits.
SLACK = 1e-9


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(term, F.lit(buckets)).cast("int")


def _as_blocks(term: np.ndarray, ids: pa.Array, weight: np.ndarray, size: int) -> pa.RecordBatch:
    """Postings in the order of their terms, cut into blocks of size at most."""
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    inside = np.arange(len(term)) - np.repeat(first, np.diff(np.concatenate([first, [len(term)]])))
    start = np.flatnonzero(inside % size == 0)
    offsets = pa.array(np.concatenate([start, [len(term)]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, pa.array(weight))]
    return pa.RecordBatch.from_arrays([pa.array(term[start]), pa.array(np.maximum.reduceat(weight, start)), pa.array(np.diff(offsets.to_numpy()).astype(np.int32)), *lists], names=["term", "most", "n", "ids", "weights"])


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists in a row, and the size of each."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _gather(size: int):
    """Sparse vectors -> blocks of the postings of HELD vectors' terms at a time, each term's by falling weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def blocks() -> pa.RecordBatch:
            term, weight, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])
            held.clear()
            order = np.lexsort((-weight, term))
            return _as_blocks(term[order], ids.take(pa.array(order)), weight[order], size)

        for batch in list_slices(batches, 1, HELD // 4):
            indices, counts = _flat(batch.column("indices"))
            values, _ = _flat(batch.column("values"))
            held.append((indices.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False), batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))))
            if sum(len(x[0]) for x in held) >= HELD:
                yield blocks()
                pa.default_memory_pool().release_unused()
        if sum(len(x[0]) for x in held):
            yield blocks()

    return run


def _gather_words(size: int):
    """Hashed words of texts -> what _gather makes of their vectors, in one worker: vectors needn't travel to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = (pa.RecordBatch.from_arrays([b.column(0), *b.column(1).flatten()], names=["id", "indices", "values"]) for b in weights_of_words(batches))
        yield from _gather(size)(vectors)

    return run


def _merge(size: int):
    """Small blocks in the order of their terms and largest weights -> full blocks. Postings are put in order by weight for
    as many rows as a batch has; between batches a term starts a new block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, 1, HELD):
            if batch.num_rows:
                ids, counts = _flat(batch.column("ids"))
                weight = _flat(batch.column("weights"))[0].to_numpy(zero_copy_only=False)
                term = np.repeat(batch.column("term").to_numpy(), counts)
                order = np.lexsort((-weight, term))
                yield _as_blocks(term[order], ids.take(pa.array(order)), weight[order], size)

    return run


def _schema(df: DataFrame, key: str) -> str:
    return f"term bigint, most double, n int, ids array<{dict(df.dtypes)[key]}>, weights array<double>"


def _write(small: DataFrame, path: str, buckets: int, block: int, mode: str) -> None:
    """Blocks as tasks gathered them -> a table of full blocks."""
    order = ["bucket", "term", F.col("most").desc()]
    dealt = small.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.select("term", "ids", "weights").mapInArrow(_merge(block), small.schema)
    write_dealt(blocks.withColumn("bucket", bucket_of(F.col("term"), buckets)), path, "bucket", mode)


def write(sparse: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, block: int = BLOCK, mode: str = "error") -> None:
    """Postings of sparse vectors (key, sparse: struct of indices and values) as a table of blocks: bucket (a folder each),
    term, most (largest weight), n, ids, weights (in falling order).

    Tasks gather the postings of their own vectors to blocks first, so that blocks travel and not postings. Blocks are
    dealt by range of term and weight, so a term of all documents spreads over many tasks, which fill them up as rows pass
    by. Mode 'append' adds blocks of further documents. Rows without key or vector have none.
    """
    rows = sparse.where(F.col(key).isNotNull() & F.col("sparse").isNotNull()).select(F.col(key).alias("id"), "sparse.indices", F.col("sparse.values").cast("array<double>").alias("values"))
    _write(rows.mapInArrow(_gather(block), _schema(sparse, key)), path, buckets, block, mode)


def build(docs: DataFrame, path: str, key: str = "id", text: str = "text", buckets: int = BUCKETS, block: int = BLOCK, mode: str = "error") -> None:
    """Postings of texts, as write makes them of their sparse vectors. Counting words and gathering postings share a worker."""
    words = hashed_words(docs.where(F.col(key).isNotNull()), key, text)
    _write(words.mapInArrow(_gather_words(block), _schema(docs, key)), path, buckets, block, mode)


def of_terms(spark: SparkSession, path: str, terms: Mapping[str, float] | Sequence[str], buckets: int = BUCKETS) -> tuple[DataFrame, dict[int, float]]:
    """The blocks of a question's terms, from their folders alone; and the question's weights by hashed term."""
    weights = terms if isinstance(terms, Mapping) else sparse_query(terms)
    hashed = spark.range(1).select(*[F.xxhash64(F.lit(t)).alias(f"t{i}") for i, t in enumerate(weights)]).first() if weights else ()
    by_term = dict(zip(hashed, weights.values(), strict=True))
    df = read_dealt(spark, path)
    return df.where(F.col("bucket").isin(*{t % buckets for t in by_term}) & F.col("term").isin(*by_term)), by_term


def _sums(blocks: DataFrame, by_term: Mapping[int, float], among: DataFrame | None) -> DataFrame:
    """id and score over blocks, of the ids in among: each posting times its term's weight, added in the order of the
    question's terms, as a scan adds them, so that ties are ties in both."""
    each = blocks.select("term", F.inline(F.arrays_zip("ids", "weights")).alias("id", "weight"))
    parts = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("weight") * F.lit(float(w)))), F.lit(0.0)) for t, w in by_term.items()]
    out = each.groupBy("id").agg(sum(parts[1:], parts[0]).alias("score"))
    return out.join(among.select("id"), "id", "left_semi") if among is not None else out


def needed(blocks: DataFrame, by_term: Mapping[int, float], k: int, among: DataFrame | None = None) -> DataFrame:
    """The blocks that may hold one of the k best: those whose largest weight, with the largest of the other terms, reaches
    the score that the k best of the heaviest blocks have. What comes to the driver is one number a term, and one score."""
    if not by_term:
        return blocks
    most = {r["term"]: by_term[r["term"]] * r["most"] for r in blocks.groupBy("term").agg(F.max("most").alias("most")).collect()}
    if not most:
        return blocks
    heaviest = F.lit(False)
    for t, m in most.items():
        heaviest = heaviest | ((F.col("term") == t) & (F.col("most") >= m * (1 - SLACK) / by_term[t]))
    found = top(_sums(blocks.where(heaviest), by_term, among), k).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    if found["n"] < k:
        return blocks
    keep = F.lit(False)
    for t, m in most.items():
        rest = sum(most.values()) - m
        keep = keep | ((F.col("term") == t) & (F.col("most") >= (found["low"] * (1 - SLACK) - rest) / by_term[t]))
    return blocks.where(keep)


def search(spark: SparkSession, path: str, terms: Mapping[str, float] | Sequence[str], k: int, among: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """id and score of the k best texts for a question's terms, ties by id: the same rows as a scan of all texts gives, or
    of the texts whose id is in among. A question without terms, or with terms that no text holds, finds nothing. Weights
    of terms must be positive."""
    blocks, by_term = of_terms(spark, path, terms, buckets)
    if any(w <= 0 for w in by_term.values()):
        raise ValueError("weights of terms must be positive")
    if not by_term:
        return blocks.select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).limit(0)
    return top(_sums(needed(blocks, by_term, k, among), by_term, among), k)


def stats(spark: SparkSession, path: str, terms: Mapping[str, float] | Sequence[str], k: int, buckets: int = BUCKETS) -> DataFrame:
    """One row: blocks and postings of the question's terms, and how many of them a search reads."""
    blocks, by_term = of_terms(spark, path, terms, buckets)
    total = lambda df, a, b: df.agg(F.count("*").alias(a), F.coalesce(F.sum("n"), F.lit(0)).alias(b))
    return total(blocks, "blocks", "postings").join(total(needed(blocks, by_term, k), "blocks_read", "postings_read"))
