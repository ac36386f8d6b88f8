"""Importance resampling towards a target: hashed runs of words, found by a ring of running checksums in one scan.

A document's features are its runs of one to n words. A scan keeps the running zlib states of the runs that began at the
last n words; the next word extends each of them by a blank and itself, and every state is a feature's hash on the way.
No feature is ever written out, and a text of any length is read in blocks with the ring carried from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch, slices

#: Bytes that are no letters, digits or parts of longer characters separate words; A-Z is lower-cased.
TABLE = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 18


def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, block by block; no word is cut."""
    plain, start = text.translate(TABLE), 0
    while start < len(plain):
        end = plain.find(b" ", start + size)
        end = len(plain) if end < 0 else end
        if words := plain[start:end].split():
            yield words
        start = end


def ring(text: bytes, n: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of all runs of 1 to n words that end in them) of each block of a text.

    last[k] is the running state of the k + 1 words before a block, or None while the text has had fewer; one step of
    the ring is done for all words of a block at a time, so that zlib is called from C.
    """
    last: list[int | None] = [None] * n
    for words in word_blocks(text, size):
        spaced = [b" " + w for w in words]
        found, states, at = [], list(map(crc32, words)), 0  # states: of the runs that end in words[at:]
        for k in range(n):
            found += states
            before, at = last[k], at if last[k] is not None else at + 1
            last[k] = states[-1] if states else before
            if k + 1 < n:
                held = states[:-1] if before is None else chain([before], states[:-1])
                states = list(map(crc32, spaced[at:], held))
        yield len(words), np.array(found, np.uint32)


def _count(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for _, found in ring(text or b"", n):
                    total += np.bincount(found % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n (long): how many features of all texts fall into each bucket that has some. A task sends one row a bucket
    at most."""
    rows = texts.select("text").mapInArrow(_count(n, buckets), "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm, rounded down: how much more frequent it is in the
    target's texts than in those of docs, both counts raised by one. The driver holds two numbers a bucket."""
    counts = np.zeros((2, buckets), np.int64)
    for i, texts in enumerate((docs, target)):
        for r in bucket_counts(texts, n, buckets).collect():
            counts[i, r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = counts.astype("f8"), counts.sum(1).astype("f8")
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def _weigh(gains: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = features = weight = 0
                for m, found in ring(text or b"", n):
                    words, features, weight = words + m, features + len(found), weight + int(gains[found % len(gains)].sum())
                out.append((words, features, weight))
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gains: np.ndarray, n: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the features' gains; none: 0), all long."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_weigh(gains, n), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (long) of every row of docs: a draw without replacement by weight.

    score is the weight plus a Gumbel number from the hash of seed and doc_id, so the highest scores are a sample in
    proportion to the weights' exponentials, the same in every run. Of the documents with least_words words, percent per
    cent (rounded down) are drawn, ties to the smaller doc_id; rank counts them from 1, others have null.

    Null and empty texts have no features and weight 0. A null doc_id is hashed as the empty string and ranks before
    others. Repeated rows are drawn as rows of their own. An empty table gives no rows; without a target all buckets
    that docs fill lose. Texts are scanned twice and never shuffled: what travels is one row a bucket and task, and four
    numbers a document, which are sorted by range; a document's rank is its place in its range behind the rows of the
    ranges before it.
    """
    gains = bucket_gains(docs, target, n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weights(docs, gains, n).select("doc_id", "n_features", "weight", (F.col("weight") + luck).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("able"))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id")]
    scratch = Scratch(docs.sparkSession, "resample")
    rows = scratch.save(rows, "scores")  # else texts would be scanned once more for the bounds of the ranges
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.save(placed, "placed")  # the upper bits of at are the range, the lower 33 the place in it
    scratch.drop("scores")
    sizes = sorted((r["part"], r["able"]) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count_if("able").alias("able")).collect())
    starts, held = [], 0
    for part, able in sizes:
        starts.append((part, held))
        held += able
    first = docs.sparkSession.createDataFrame(starts, "part bigint, start bigint")  # one row a range
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(first), F.shiftright("at", 33) == F.col("part"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= held * percent // 100), rank).alias("rank"))
