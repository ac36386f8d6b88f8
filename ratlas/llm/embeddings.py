"""Near duplicates among embeddings: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.blocks import blocks, components, each_block, matrix
from ratlas.llm.common import Scratch
from ratlas.llm.graph import connected_components


#: What vectors of one bucket share; a bucket is a hash of it.
WITHIN = ("label", "table", "code", "size")


def plan_tables(rows: int, cosine: float, recall: float = 0.998, least_bits: int = 8) -> tuple[int, int]:
    """Bits of a table's code and number of tables, for this many rows in the largest label.

    Bits grow with the logarithm of the rows, so that buckets of unrelated vectors keep their size; the number of
    tables then follows from the share of pairs at exactly `cosine` that must meet in one table at least.
    """
    bits = min(30, max(least_bits, math.ceil(math.log2(max(rows, 1) / 64))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _rows_of(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors, by length: their rows and a matrix in double precision. Not usable: null or empty, zero, or with
    null or non-finite components."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        v = flat[start[at][:, None] + np.arange(n)]
        good = np.isfinite(v).all(1) & v.any(1)
        yield at[good], v[good]


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    wide = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(wide)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(bits: int, tables: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                order, raws, codes = [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [pa.array([], pa.binary())]
                for at, v in _rows_of(batch.column("embedding")):
                    if v.shape[1] not in planes:
                        planes[v.shape[1]] = np.random.default_rng([seed, v.shape[1]]).standard_normal((v.shape[1], bits * tables))
                    signs = (_unit(v) @ planes[v.shape[1]] > 0).reshape(len(v), tables, bits)
                    order.append(at)
                    raws.append(_binary(v.astype(kind)))
                    codes.append(_binary((signs @ (1 << np.arange(bits))).astype("<u4")))
                place = np.full(batch.num_rows, -1)
                place[np.concatenate(order)] = np.arange(sum(map(len, order)))
                index = pa.array(place, mask=place < 0)
                cols = [pa.concat_arrays(x).take(index) for x in (raws, codes)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *cols], names=["vec_id", "label", "raw", "codes"])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision."""
    v = v.astype("f8")
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _compare(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_block(batches, "bucket", WITHIN):
            number, ids, side = (t.column(c).to_numpy() for c in ("number", "id", "side"))
            weight, table = t.column("weight").to_numpy(), int(t.column("table")[0].as_py())
            if len(ids) < 2:
                continue
            unit, codes = _unit(matrix(t.column("raw"), kind)), matrix(t.column("codes"), "<u4")
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            if t.column("side_a")[0].as_py() != t.column("side_b")[0].as_py():
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            first = linked.copy()  # a pair counts in the first table in which it meets
            for k in range(table):
                first &= codes[:, k, None] != codes[None, :, k]
            near = first @ weight
            root = ids[components(linked)]
            some = linked.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(ids[some]), pa.array(near[some].astype("i8")), pa.array(root[some])], names=["number", "id", "near", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.8, seed: int = 11) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label link if their cosine, in double precision, is at least `cosine`. A null label and vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing; n_links is then 0 and component_id
    is vec_id. Vectors of different lengths never link. kept: vec_id = component_id.

    Equal vectors are first joined to classes, so copies cost one row. Classes meet in buckets of several tables;
    each bucket is compared in blocks of bounded size whose links are counted, not emitted: a pair counts in the first
    table in which its codes agree. What leaves a block is one row a vector, with its count and its component there.
    Rows that share a vec_id are one node of the components; their links are counted apart, also between them. Rows without vec_id link with
    nothing; columns other than the three are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select("vec_id", "label", "embedding")
    largest = rows.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, cosine)
    kind = dict(rows.dtypes)
    number = "<f4" if kind["embedding"] == "array<float>" else "<f8"
    coded = scratch.save(rows.mapInArrow(_codes(bits, tables, seed, number), f"vec_id {kind['vec_id']}, label {kind['label']}, raw binary, codes binary"), "coded")
    # a class: the same vector under one label; its id is the smallest vec_id
    usable = F.col("raw").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.sha2(F.concat(F.col("raw"), F.lit("|").cast("binary"), F.col("label").cast("string").cast("binary")), 256))
    real = coded.withColumn("key", key).where("key IS NOT NULL")
    classes = scratch.save(real.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("codes").alias("codes")).withColumn("number", F.monotonically_increasing_id()), "classes")
    codes = F.expr(f"transform(sequence(0, {tables - 1}), i -> substring(codes, i * 4 + 1, 4))")
    spread = classes.select("number", "id", "label", F.octet_length("raw").alias("size"), F.posexplode(codes).alias("table", "code"))
    spread = spread.withColumn("bucket", F.xxhash64(*WITHIN))
    met = blocks(spread, "bucket", "number", classes.select("number", "weight", "raw", "codes"), within=WITHIN)
    found = met.mapInArrow(_compare(cosine, number), "number bigint, id bigint, near bigint, root bigint")
    found = scratch.save(found.groupBy("number", "id", "root").agg(F.sum("near").alias("near")), "found")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    near = found.groupBy("number").agg(F.sum("near").alias("near"))
    result = classes.select("key", "number", "id", "weight").join(near, "number", "left").join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left")
    result = scratch.save(result.select("key", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "result")
    scratch.drop("classes", "found")
    keyed = coded.select("vec_id", key.alias("key"))
    out = keyed.join(result, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
