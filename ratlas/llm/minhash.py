"""Near duplicates among texts: circulant MinHash, banding, exact Jaccard similarity, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.blocks import CHUNK, blocks, each_block
from ratlas.llm.common import Scratch, slices, split_words, strings
from ratlas.llm.graph import connected_components

#: Bands and coordinates of a band: two texts of similarity 0.8 miss each other in every band once in 16,000 times.
BANDS, ROWS = 32, 6
#: Shingles that are permuted at once, so that they stay in the processor's cache.
_SPAN = 1 << 15


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, ascending, all in a row, and how many each text has.

    Words are those of the lower-cased (A-Z) text; a text with fewer words than a shingle has one, its whole sequence;
    a text without words has none.
    """
    flat, n = split_words(pc.ascii_lower(strings(text)))
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    h = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    m = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(ends - n, m)
    stop = ends[doc] if len(doc) else at
    acc = h[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, words):
        pos = at + j
        inside = pos < stop
        nxt = _mix64(acc) + h[np.where(inside, pos, 0)] if len(at) else acc
        acc = np.where(inside, nxt, acc)
    acc = _mix64(acc)
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], np.bincount(doc[new], minlength=len(n)) if len(n) else n


def signatures(shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: a row of `size` coordinates (uint32) for every text with a shingle.

    The first permutation scatters the shingles over a circle of 2^32 places. Coordinate k is the smallest value that
    the second permutation, shifted k places along the circle, gives to any of them.
    """
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), size), np.uint32)
    place = (_mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SPAN)))
        x = place[starts[i] : starts[j - 1] + counts[j - 1]]
        cut = starts[i:j] - starts[i]
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(size):
            np.subtract(x, np.uint32(k), out=y)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(y, np.uint32(shift), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(factor), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[i:j, k] = np.minimum.reduceat(y, cut)
        i = j
    return out


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"), words)
            real = counts > 0
            sig = signatures(sets, counts, BANDS * ROWS)
            acc = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(sig), 0)
            for r in range(ROWS):
                acc = _mix64(acc) + sig[:, r::ROWS].astype(np.uint64)
            starts = (np.cumsum(counts) - counts)[real]
            key = np.zeros((len(sig), 2), np.uint64)
            for k, salt in enumerate((0x2545F4914F6CDD1D, 0x60BEE2BEE120FC15)):
                if len(sig):
                    key[:, k] = _mix64(np.add.reduceat(_mix64(sets ^ np.uint64(salt)), starts)) + counts[real].astype(np.uint64)
            at = np.full(len(counts), -1)
            at[real] = np.arange(len(sig))
            index = pa.array(at, mask=~real)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(_mix64(acc).view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            keys = pa.array([x.tobytes() for x in key], pa.binary())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), keys.take(index), bands.take(index)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"), words)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "shingles"])

    return run


#: Hashes below this are looked at first: a quarter of a set.
_QUARTER = np.uint64(1 << 62)


class Sets:
    """Shingle sets, ascending, in a row; which of them are similar enough to one of them."""

    def __init__(self, lists: pa.Array, percent: int):
        self.percent = percent
        self.start = lists.offsets.to_numpy().astype(np.int64)
        self.all = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        self.size = np.diff(self.start)
        low = np.concatenate([[0], np.cumsum(self.all < _QUARTER)])
        self.first = low[self.start[1:] - self.start[0]] - low[self.start[:-1] - self.start[0]]

    def _shared(self, mine: np.ndarray, rest: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How many of the first so many shingles of each of rest are among mine."""
        if not len(mine):
            return np.zeros(len(rest), np.int64)
        at = np.repeat(self.start[rest] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        wanted = self.all[at]
        same = mine[np.minimum(np.searchsorted(mine, wanted), len(mine) - 1)] == wanted
        total = np.concatenate([[0], np.cumsum(same)])
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def similar(self, mine: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Those of rest whose sets overlap with mine by percent / 100 of the union. What is left out early can't reach
        that: sets of too different sizes, and sets whose first quarters share so little that all else would not do."""
        n, size = len(mine), self.size[rest]
        rest = rest[100 * np.minimum(n, size) >= self.percent * np.maximum(n, size)]
        first = int(np.searchsorted(mine, _QUARTER))
        size, count = self.size[rest], self.first[rest]
        most = self._shared(mine[:first], rest, count) + np.minimum(n - first, size - count)
        rest = rest[100 * most >= self.percent * (n + size - most)]
        same = self._shared(mine, rest, self.size[rest])
        return rest[100 * same >= self.percent * (n + self.size[rest] - same)]

    def of(self, i: int) -> np.ndarray:
        return self.all[self.start[i] : self.start[i + 1]]


def _compare(percent: int):
    """Links of a block that join its components. A pair that has met in an earlier band or that links found before have
    joined is skipped; all others are compared on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_block(batches, "bucket"):
            ids, part, side = (t.column(c).to_numpy() for c in ("id", "part", "side"))
            across = t.column("side_a")[0].as_py() != t.column("side_b")[0].as_py()
            bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
            here = int(np.argmax(bands[0] == t.column("bucket")[0].as_py()))
            sets, found = Sets(t.column("shingles").combine_chunks(), percent), []
            for i in range(len(ids) - 1):
                open_ = part[i + 1 :] != part[i]
                if across:
                    open_ &= side[i + 1 :] != side[i]
                rest = i + 1 + np.flatnonzero(open_)
                if len(rest) and here:
                    rest = rest[~(bands[rest, :here] == bands[i, :here]).any(1)]
                if not len(rest):
                    continue
                for j in sets.similar(sets.of(i), rest):
                    if part[j] != part[i]:
                        found.append((ids[i], ids[j]))
                        part = np.where(part == part[j], part[i], part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _stars(percent: int):
    """Sorted by star and chunk, its centre before its members: the members that are similar enough to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, centre = None, None
        for batch in batches:
            sets = Sets(batch.column("shingles"), percent)
            a, b, chunk = (batch.column(c).to_numpy() for c in ("a", "b", "chunk"))
            cuts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1]))[: len(a)]).tolist()
            links: list[tuple[int, int]] = []
            for low, high in zip(cuts, [*cuts[1:], len(a)], strict=True):
                if here != (a[low], chunk[low]):
                    here, centre = (a[low], chunk[low]), sets.of(low).copy()
                rest = np.arange(low, high)
                links += [(a[j], b[j]) for j in sets.similar(centre, rest[b[low:high] != a[low]])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """The pairs (centre a, member b) whose sets are similar enough, on the full sets. A centre's members are dealt into
    chunks, and its set goes to each chunk once, not to each member."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / chunk)).cast("int").alias("chunk")
    members = pairs.join(sizes, "a").select("a", dealt, "b")
    centres = sizes.select("a", F.explode(F.expr(f"sequence(0, cast(ceil(n / {chunk}) as int) - 1)")).alias("chunk"), F.col("a").alias("b"))
    rows = members.union(centres).join(sets.withColumnRenamed("id", "b"), "b").select("a", "chunk", "b", "shingles")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b") != F.col("a"))
    return rows.mapInArrow(_stars(percent), "a bigint, b bigint")


def near_texts(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (long), component_id, kept.

    Documents link if their sets of distinct shingles of `words` words overlap by percent / 100 of their union; links
    are confirmed on the full sets. component_id is the smallest doc_id reachable, kept tells whether it is the row's
    own. Null, empty and blank texts have no shingles and link with nothing, nor do rows without doc_id. Rows that
    share a doc_id count as one document.

    Documents with equal sets form a class and count once. Classes meet in buckets, one for each band. First every
    member of a bucket is compared with the bucket's smallest; what that links is joined to components. Then, in
    buckets that still hold several components, all pairs across components are compared, in blocks of bounded size that
    give out no pairs but the links that join components. So a group of thousands of copies costs little more than a
    comparison each, and no link between components that share a bucket is left out. Only classes in shared buckets have
    their sets computed again. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    kind = dict(docs.dtypes)["doc_id"]
    signed = scratch.save(docs.select("doc_id", "text").mapInArrow(_sign(words), f"doc_id {kind}, n_shingles bigint, key binary, bands array<bigint>"), "signed")
    real = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = real.groupBy("key").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = scratch.save(classes, "classes")
    spread = classes.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = scratch.save(spread.join(shared.select("bucket", "first"), "bucket"), "members")
    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    sets = scratch.save(texts.mapInArrow(_sets(words), f"id {kind}, shingles array<bigint>"), "sets")
    stars = scratch.save(members.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = scratch.save(_linked(stars, sets, percent), "links-1")
    parts = scratch.save(connected_components(links), "parts-1")
    # buckets in which components still meet
    placed = members.join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").select("bucket", "id", F.coalesce("component", "id").alias("part"))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bucket")
    payload = classes.select("id", "bands").join(sets, "id")
    more = scratch.save(blocks(placed.join(mixed, "bucket"), "bucket", "id", payload).mapInArrow(_compare(percent), "a bigint, b bigint"), "links-2")
    if not more.isEmpty():
        parts = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.select("key", "id").join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").select("key", F.coalesce("component", "id").alias("component_id"))
    named = scratch.save(named, "named")
    scratch.drop("classes", "members", "sets", "stars", "links-1", "parts-1", "links-2")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_texts(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the document with the smallest doc_id stays."""
    gone = near_texts(docs, words, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
