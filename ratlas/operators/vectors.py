"""Hybrid retrieval: cosine and term scores, rank fusion, and the index behind them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameters of the term weights and of the fusion; the usual ones, stated in the README.
K1, B, MEAN_LENGTH, FUSION = 1.2, 0.75, 256, 60
INSTRUCTION = "Find council documents that answer the question"


def top(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k rows of the largest score, ties by key; each partition sends k rows at most."""
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def cosine(vectors: DataFrame, query: Sequence[float], key: str = "id", dense: str = "dense") -> DataFrame:
    """key, score of every vector of the query's length that isn't null or zero and whose components are finite; only
    ids and vectors are read. A query that is zero or not finite scores nothing."""
    q = np.array(query, "f8")
    usable = len(q) > 0 and bool(np.isfinite(q).all()) and bool(q.any())
    q = q / np.linalg.norm(q) if usable else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            use = lists.is_valid().to_numpy(zero_copy_only=False) & (size == len(q)) & usable
            keep = batch.filter(pa.array(use))
            m = keep.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, max(1, len(q)))
            ok = np.isfinite(m).all(1) & m.any(1)
            m = m[ok]
            m = m / np.abs(m).max(1, keepdims=True) if len(m) else m  # so that no square overflows
            score = m @ q / np.sqrt((m * m).sum(1)) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([keep.column(0).filter(pa.array(ok)) if usable else keep.column(0), pa.array(score)], names=[key, "score"])

    return vectors.select(key, dense).mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, score double")


def query_text(text: str, instruction: str = INSTRUCTION) -> str:
    """A question as embedding models of this kind take it: with an instruction before it."""
    return f"Instruct: {instruction}\nQuery: {text}"


def sparse_query(query: Sequence[str]) -> dict[str, float]:
    """The weights of a question's terms: each distinct one counts 1."""
    return dict.fromkeys((w.lower() for w in query), 1.0)


def tokens(text: Column) -> Column:
    """Words of two letters or digits at least, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))


def term_scores(docs: DataFrame, query: Sequence[str], key: str = "id", text: str = "text") -> DataFrame:
    """key, score: the sum of saturated frequencies of the query's distinct terms, for texts that hold one.

    Without document frequencies, as the index sets none, a text's score needs no other text: nothing is shuffled. Texts
    without any of the terms' letters are left out before they are taken apart; the others are taken apart once, as the
    score stands behind a generator of one row, below which no condition moves.
    """
    terms = list(sparse_query(query))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    held = F.lower(F.col(text)).rlike("|".join(map(re.escape, terms)))
    df = docs.where(held).select(key, tokens(F.col(text)).alias("t"))
    rest = K1 * (1 - B + B * F.size("t") / MEAN_LENGTH)
    weight = lambda q: (lambda tf: tf * (K1 + 1) / (tf + rest))(F.size(F.filter("t", lambda x: x == q)))
    parts = [weight(q) for q in terms]
    return df.select(key, F.explode(F.array(sum(parts[1:], parts[0]))).alias("score")).where("score > 0")


def list_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the lists of a column hold some `most` values at once; one longer list stands alone."""
    for batch in batches:
        offsets, start = batch.column(column).offsets.to_numpy(), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


#: Words that are counted at once.
WORDS = 1 << 18


def weights_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hashed_words -> each text's distinct hashes in order, and their weights."""
    for batch in list_slices(batches, 1, WORDS):
        lists = batch.column(1)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        flat = flat[offsets[0] : offsets[-1]] if len(offsets) else flat
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])) if len(flat) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate([first, [len(flat)]])).astype("f8")
        rest = K1 * (1 - B + B * size[row[first]].astype("f8") / MEAN_LENGTH)
        stops = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(size)))]).astype(np.int32)
        pairs = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x)) for x in (flat[first].astype(np.int64), tf * (K1 + 1) / (tf + rest))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(pairs, names=["indices", "values"])], names=[batch.schema.names[0], "sparse"])


def hashed_words(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key and t, the hashes of a text's words, of texts that have some."""
    return docs.select(key, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("t")).where(F.size("t") > 0)


def sparse_vectors(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key and the weights of a text's terms as sorted arrays of hashed indices and values; texts without terms have no row.
    A text's words are counted where it lies, so nothing is shuffled."""
    return hashed_words(docs, key, text).mapInArrow(weights_of_words, f"{key} {dict(docs.dtypes)[key]}, sparse struct<indices:array<bigint>,values:array<double>>")


def ranked(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The first k with their rank from 1; the window sees k rows."""
    return top(scored, k, key).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def fuse(lists: Sequence[DataFrame], k: int, key: str = "id", constant: int = FUSION) -> DataFrame:
    """Reciprocal ranks added over lists: key, score of the first k."""
    union = lists[0].select(key, "rank")
    for x in lists[1:]:
        union = union.unionAll(x.select(key, "rank"))
    return top(union.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score")), k, key)


def hybrid(vectors: DataFrame, docs: DataFrame, query_vector: Sequence[float], query: Sequence[str], k: int = 10, where: Column | None = None, key: str = "id") -> DataFrame:
    """The k best of both lists of 3 k; a filter on either side's columns holds before anything is ranked."""
    if where is not None:
        vectors, docs = vectors.where(where), docs.where(where)
    dense = ranked(cosine(vectors, query_vector, key), 3 * k, key)
    sparse = ranked(term_scores(docs, query, key), 3 * k, key)
    return fuse([dense, sparse], k, key)


def pair_vectors(dense: DataFrame, sparse: DataFrame, key: str = "id") -> DataFrame:
    """Dense and sparse vectors of the same keys; raises ValueError if a key lacks one of them."""
    both = dense.join(sparse, key, "full")
    if not both.where("dense IS NULL OR sparse IS NULL").isEmpty():
        raise ValueError("dense and sparse vectors don't pair")
    return both


def hashing_embedder(size: int = 64):
    """A stand-in for a model: a function from texts to vectors of unit length, the same everywhere."""

    @F.udf("array<float>", useArrow=True)
    def embed(t: str | None) -> list[float]:
        import zlib

        v = np.zeros(size)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h >> 16 & 1 else -1
        n = math.sqrt(v @ v)
        return (v / n if n else v).tolist()

    return embed
