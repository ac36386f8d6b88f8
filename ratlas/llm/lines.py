"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratlas.llm.common import SPACE, Scratch, slices


#: Shared keys that go to every task with their holders.
MOST_SHARED = 200_000


def _mark(text: Column) -> Column:
    """Tells texts of rows without doc_id apart."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def line_key(line: str, least_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())  # of bytes, lower() folds A-Z only


def _keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, marks, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = {k for line in (text or "").split("\n") if (k := line_key(line, least_chars))}
                ids += [doc_id] * len(found)
                marks += [zlib.crc32((text or "").encode())] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(marks, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "mark", "key"])

    return run


def _drop(least_chars: int, names: list[str], holders: dict[bytes, object] | None):
    """Texts without their shared lines, by the holders of shared keys or, without those, by each row's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, totals, dropped = [], [], []
            own = batch.column("__bad" if holders is None else "__id").to_pylist()
            for text, mine in zip(batch.column("text").to_pylist(), own, strict=True):
                lines = (text or "").split("\n")
                stay = lines
                if holders is None:
                    if mine:
                        gone = set(mine)
                        stay = [x for x in lines if line_key(x, least_chars) not in gone]
                elif holders:
                    stay = [x for x in lines if (k := line_key(x, least_chars)) not in holders or holders[k] == mine]
                texts.append("\n".join(stay))
                totals.append(len(lines))
                dropped.append(len(lines) - len(stay))
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, counts: tuple[str, str] = ("n_lines", "n_dropped"), most_shared: int = MOST_SHARED) -> DataFrame:
    """docs with text freed of shared lines, and the number of its lines before and of those dropped (long), under the
    names in counts; columns of docs with these names are replaced.

    A text is split at line feeds (null or empty: one empty line). A line's key is the line without white space at its
    ends, A-Z in lower case. Keys of at least least_chars code points that at least least_docs different doc_ids hold
    lose all their lines, except those in the largest doc_id that holds them. Other lines stay, in their order.

    Each document hands in every key once, so a line in a third of all documents is summed before it is shuffled; only
    hashes and ids travel. Up to most_shared shared keys go to every task with their holders (some 100 bytes each), and
    no text is shuffled. More than that are joined with the keys of documents, where Spark can split a frequent key; the
    verdicts then come back as one list for each text that loses something, and texts without any stay in place as far
    as the join allows. Rows that share a doc_id count as one document; a row without doc_id is no holder and loses
    shared lines. Repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text").mapInArrow(_keys(least_chars), f"doc_id {kind}, mark bigint, key binary")
    keys = scratch.save(keyed, "keys")
    shared = keys.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= least_docs)
    shared = scratch.save(shared.select("key", "holder"), "shared")
    names = [c for c in docs.columns if c not in counts]
    plain = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]  # Arrow functions take no dotted names
    columns = [F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)]
    if shared.count() <= most_shared:
        holders = {bytes(r["key"]): r["holder"] for r in shared.collect()}
        scratch.drop()
        rows = docs.select(*columns, F.col("doc_id").alias("__id"))
    else:
        holders = None
        losing = keys.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        bad = losing.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("key").alias("__bad"))
        own = F.col("__doc").eqNullSafe(F.col("__id")) & (_mark(F.col("text")) == F.col("__mark"))
        rows = docs.select(*columns, F.col("doc_id").alias("__doc")).join(bad, own, "left").drop("__doc", "__id", "__mark")
    schema = StructType(rows.schema.fields[:-1]).add("n_lines", "long").add("n_dropped", "long")
    return rows.mapInArrow(_drop(least_chars, plain, holders), schema).toDF(*names, *counts)
