"""Substring search through postings of trigrams over distinct values: candidates by intersection, then the exact condition.

Many rows share few values, so runs of three letters are indexed for values, and values for the rows that hold them. A value
that holds a term holds all runs of the term: the postings of the rarest runs are intersected, and the values that are left
are looked at. Terms of fewer than three letters have no runs; all values, but no rows, are looked at for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.functions.text import as_text
from ratlas.operators import sessions as listing
from ratlas.operators.vectors import list_slices
from ratlas.sources.shared import read_dealt, write_dealt

#: Folders of a table, ids of a block, runs of a term that are intersected, texts that a task inverts at a time, and names
#: that go to every task; more are joined.
BUCKETS, BLOCK, MOST_RUNS, HELD, MOST_NAMES = 32, 1024, 4, 1 << 20, 100_000
#: Terms whose finding a number holds as bits.
BITS = 60
#: Columns of a search that documents have from their session, and those they have themselves.
OF_SESSION = ("date", "committee", "meeting_name")
OWN = tuple(c for c in listing.SEARCHED if c not in OF_SESSION)


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a value by its hash."""
    return F.pmod(name, F.lit(buckets)).cast("int")


def grams(texts: Column) -> Column:
    """The distinct runs of three letters of an array of texts, in lower case; none runs from one text into another."""
    one = lambda t: F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substr(t, i, F.lit(3)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: one(F.lower(as_text(t))))))


def runs_of(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2)))


def literals(pattern: str) -> list[str]:
    """What a LIKE pattern asks for word by word, between its wildcards."""
    return [x for x in re.split(r"[%_\\]", pattern) if x]


def _invert(size: int, most: int = HELD):
    """Rows (id, texts) -> blocks (value, n, ids) of the rows of some `most` texts at a time: each distinct text, nulls and
    empty ones left out, with the ids of the rows that have it, size of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def blocks() -> pa.RecordBatch:
            coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            ids, counts = pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            use = np.array([bool(v) for v in coded.dictionary.to_pylist()] + [False])  # the last stands for null
            code, row = coded.indices.fill_null(len(use) - 1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
            code, row = code[use[code]], row[use[code]]
            order = np.argsort(code, kind="stable")  # rows stay in their order
            code, row = code[order], row[order]
            if len(code):
                new = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
                code, row = code[new], row[new]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            inside = np.arange(len(code)) - np.repeat(first, np.diff(np.concatenate([first, [len(code)]])))
            start = np.flatnonzero(inside % size == 0)
            offsets = np.concatenate([start, [len(code)]]).astype(np.int32)
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[start])), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(row)))], names=["value", "n", "ids"])

        for batch in list_slices(batches, 1, most):
            lists = batch.column(1)
            held.append((lists.flatten(), batch.column(0), np.diff(lists.offsets.to_numpy())))
            if sum(len(x[0]) for x in held) >= most:
                yield blocks()
        if held:
            yield blocks()

    return run


def _post(rows: DataFrame, path: str, buckets: int, block: int, mode: str) -> None:
    """Rows (id, texts) as a table of blocks: bucket (a folder each), value, n, ids. A task inverts the rows it reads and
    writes their blocks itself: rows are read once, and nothing travels."""
    blocks = rows.mapInArrow(_invert(block), f"value string, n int, ids array<{dict(rows.dtypes)['id']}>").withColumn("bucket", bucket_of(F.xxhash64("value"), buckets))
    write_dealt(blocks.sortWithinPartitions("bucket", "value"), path, "bucket", mode)


def build(rows: DataFrame, columns: Sequence[str], path: str, key: str = "id", block: int = BLOCK, mode: str = "error") -> None:
    """Three tables for rows over columns: holders (of each value the keys of the rows that have it), values (in lower case),
    and grams (of each run of three letters, the hashes of the values that have it). Mode 'append' adds further rows. Rows
    without key are left out; two values of one hash only make more candidates.

    The rows are read for the holders alone; values are taken from these."""
    texts = F.array(*[F.lower(F.col(c).cast("string")) for c in columns])
    _post(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), texts.alias("texts")), f"{path}/holders", BUCKETS, block, mode)
    spark, again = rows.sparkSession, "overwrite" if mode == "append" else mode
    write_dealt(read_dealt(spark, f"{path}/holders").select("value", "bucket").distinct().sortWithinPartitions("bucket", "value"), f"{path}/values", "bucket", again)
    known = read_dealt(spark, f"{path}/values").select(F.xxhash64("value").alias("id"), grams(F.array("value")).alias("texts"))
    _post(known, f"{path}/grams", BUCKETS, block, again)


def values_with(spark: SparkSession, path: str, term: str, most_runs: int = MOST_RUNS) -> DataFrame:
    """name (hash) of the values that hold a term (in lower case). How frequent its runs are is read from the blocks'
    numbers alone; the rarest most_runs are intersected. What comes to the driver is one number a run of the term."""
    known = read_dealt(spark, f"{path}/values").withColumn("name", F.xxhash64("value"))
    if asked := runs_of(term):
        where = {r["g"]: r["b"] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("g")).withColumn("b", bucket_of(F.xxhash64("g"))).collect()}
        of = lambda chosen: read_dealt(spark, f"{path}/grams").where(F.col("bucket").isin(*{where[g] for g in chosen}) & F.col("value").isin(*chosen))
        held = {r["value"]: r["n"] for r in of(asked).groupBy("value").agg(F.sum("n").alias("n")).collect()}
        chosen = sorted(asked, key=lambda g: (held.get(g, 0), g))[:most_runs]
        ids = of(chosen).select(F.col("value").alias("gram"), F.explode("ids").alias("name"))
        few = ids.groupBy("name").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("name")
        known = known.join(few.withColumn("bucket", bucket_of(F.col("name"))), ["bucket", "name"], "left_semi")
    return known.where(F.contains("value", F.lit(term))).select("name").distinct()


def _asked(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms if t))


def _marked(spark: SparkSession, path: str, terms: Sequence[str]) -> tuple[DataFrame, set[int]]:
    """(id, __b0, __b1 and so on: bits of the terms that a row holds) of the rows that hold a term, and the places of the terms
    that some row holds. Up to MOST_NAMES values go to the blocks of their folders, so no others are read; more are joined."""
    found = reduce(DataFrame.unionByName, [values_with(spark, path, t).select("name", F.lit(i).alias("term")) for i, t in enumerate(terms)])
    few, blocks = found.limit(MOST_NAMES + 1).collect(), read_dealt(spark, f"{path}/holders")
    if len(few) <= MOST_NAMES:
        folders = {r["name"] % BUCKETS for r in few}
        blocks, chosen, held = blocks.where(F.col("bucket").isin(*folders) if folders else F.lit(False)), F.broadcast(spark.createDataFrame(few, found.schema)), {r["term"] for r in few}
    else:
        chosen, held = found, {r["term"] for r in found.select("term").distinct().collect()}
    rows = blocks.withColumn("name", F.xxhash64("value")).join(chosen, "name").select("term", F.explode("ids").alias("id"))
    bits = [F.bit_or(F.when(F.col("term").between(p[0], p[-1]), F.expr(f"shiftleft(1L, term - {p[0]})")).otherwise(F.lit(0).cast("long"))).alias(f"__b{i}") for i, p in enumerate(_parts(terms))]
    return rows.groupBy("id").agg(*bits), held


def _parts(terms: Sequence[str]) -> list[range]:
    return [range(i, min(i + BITS, len(terms))) for i in range(0, len(terms), BITS)]


def _every(terms: Sequence[str], bits) -> Column:
    """Whether bits(i), those of a part of the terms, are all set."""
    return reduce(lambda a, b: a & b, [bits(i) == (1 << len(p)) - 1 for i, p in enumerate(_parts(terms))])


def candidates(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame | None:
    """id of the rows that hold every term in one of their values, or None without terms."""
    if not (asked := _asked(terms)):
        return None
    return _marked(spark, path, asked)[0].where(_every(asked, lambda i: F.col(f"__b{i}"))).select("id")


def narrowed(rows: DataFrame, path: str, terms: Sequence[str], key: str = "id") -> DataFrame:
    """The rows that may hold all terms, by a semi-join with the candidates; all rows without terms. What follows must
    still apply its condition."""
    found = candidates(rows.sparkSession, path, terms)
    return rows if found is None else rows.join(found.withColumnRenamed("id", key), key, "left_semi")


def index_documents(documents: DataFrame, sessions: DataFrame, path: str) -> None:
    """Postings of documents over the columns that a search looks into, and of sessions over those that documents have from
    them: the two aren't joined, and a session's values are held once."""
    build(documents, OWN, path)
    build(sessions, OF_SESSION, f"{path}/sessions", "session_id")


def narrowed_documents(documents: DataFrame, path: str, terms: Sequence[str]) -> DataFrame:
    """The documents that may hold all terms, each themselves or by their session; all without terms. A term that no session
    holds is asked of the documents where they lie, so others don't travel to the candidates."""
    if not (asked := _asked(terms)):
        return documents
    spark = documents.sparkSession
    own, (theirs, held) = _marked(spark, path, asked)[0], _marked(spark, f"{path}/sessions", asked)
    for term in (t for i, t in enumerate(asked) if i not in held):
        documents = documents.where(listing.within(OWN, term))
    if not held:
        return documents.join(own.where(_every(asked, lambda i: F.col(f"__b{i}"))).select("id"), "id", "left_semi")
    names = {f"__b{i}": f"__s{i}" for i in range(len(_parts(asked)))}
    df = documents.where("id IS NOT NULL").join(theirs.withColumnsRenamed({"id": "session_id", **names}), "session_id", "left").join(own, "id", "left")
    df = df.where(_every(asked, lambda i: F.coalesce(F.col(f"__s{i}"), F.lit(0)).bitwiseOR(F.coalesce(F.col(f"__b{i}"), F.lit(0)))))
    return df.select(*documents.columns)


def search(documents: DataFrame, sessions: DataFrame, query: str, path: str, limit: int = listing.MOST_RESULTS) -> DataFrame:
    """The rows of sessions.search, which looks only at documents that may hold all words of the query."""
    return listing.search(narrowed_documents(documents, path, query.split()), sessions, query, limit)


def filtered(sessions: DataFrame, f: listing.Filters, today: str, path: str) -> DataFrame:
    """The rows of sessions.filtered through postings of meeting_name and committee."""
    return listing.filtered(narrowed(sessions, path, literals(f.search), "session_id"), f, today)
