"""Buckets as blocks of bounded size, for operators that compare all members of a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a bucket that are compared at once.
CHUNK = 1024


def blocks(members: DataFrame, bucket: str, by: str, payload: DataFrame, chunk: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """members of buckets with two members at least, with block, side_a and side_b and the columns of payload (one row
    for each `by`), sorted by block in each partition. members should be narrow: only their way to the blocks, the last
    shuffle, carries the payload.

    A bucket of up to chunk members is one block. A larger one is dealt into chunks by a hash of `by`; every pair of
    chunks, and every chunk with itself, is a block of its own, so that any pair of members meets in exactly one block
    and no task holds more than two chunks. side_a != side_b marks a pair of chunks; side tells which one a row is in.
    A bucket may be a hash: the columns `within` part the members of different buckets that share one. All pairs of a
    bucket of n need each member beside n / chunk chunks, so its payload travels as often; buckets are to be small.
    """
    chunk = chunk or CHUNK
    sizes = members.groupBy(bucket).agg(F.count("*").alias("__n")).where("__n > 1")
    df = members.join(sizes, bucket)
    parts = F.ceil(F.col("__n") / chunk).cast("int")
    df = df.withColumn("__parts", parts).withColumn("side", F.pmod(F.xxhash64(F.lit(5), by), F.col("__parts")).cast("int"))
    df = df.withColumn("__other", F.explode(F.expr("sequence(0, __parts - 1)")))
    df = df.withColumn("side_a", F.least("side", "__other")).withColumn("side_b", F.greatest("side", "__other"))
    df = df.withColumn("block", F.xxhash64(bucket, "side_a", "side_b")).drop("__n", "__parts", "__other")
    return df.join(payload, by).repartition("block").sortWithinPartitions("block", bucket, *within, "side_a", "side_b", "side", by)


def each_block(batches: Iterator[pa.RecordBatch], bucket: str, within: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """The blocks that a sorted partition holds, one after the other."""
    held: list[pa.RecordBatch] = []
    keys = (bucket, *within, "side_a", "side_b")

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(c)[i].as_py() for c in keys)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in keys:
            x = batch.column(c)
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and key(batch, 0) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = key(batch, batch.num_rows - 1)
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def components(linked: np.ndarray) -> np.ndarray:
    """The component of each member, as its smallest index, from a symmetric matrix of links."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            seen = front.copy()
            while front.any():
                front = linked[front].any(0) & ~seen
                seen |= front
            label[seen] = i
    return label
