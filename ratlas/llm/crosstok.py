"""Alignment of two tokenizers over a corpus: distinct segments are tokenised and aligned once, documents are composed.

A text with a blank before it is cut before blanks that follow no white space. verify() proves from the vocabularies that
no token of either reaches across such a cut, so a document's tokens are those of its segments in a row, and both
tokenizers end a token at every cut. What is known of a segment then adds up to what is known of a document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch, slices, strings

#: Bytes of text whose segments are collected before they travel: the more, the fewer of them are repeated.
CHUNK_BYTES = 16 << 20
#: Pairs of ids that may go to every task with their counts, at 17 bytes each; more are joined.
MOST_PAIRS = 1 << 21
#: Segments that are tokenised, and pairs that are counted, before a task hands them on.
STEP = 20_000
#: Characters that may be white space to either tokenizer; no cut is made behind one.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A blank that isn't a cut: behind white space, or at an end of the text.
UNEVEN = rf"[{SPACES}] |^ | $"
#: Fixed value: what the piece model writes for a blank; a text that holds it is not given back by its pieces.
MARK = "▁"
_pairs: dict[tuple[str, str], Pair] = {}


class Pair:
    """A: a byte-level BPE file of the tokenizers library. B: a sentencepiece model that adds a blank and falls back to
    bytes."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        # byte-level files write visible bytes as themselves and the others as the characters from U+0100 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    @classmethod
    def of(cls, a: str, b: str) -> Pair:
        """The process's own for two files."""
        if (a, b) not in _pairs:
            _pairs[a, b] = cls(a, b)
        return _pairs[a, b]

    def verify(self) -> None:
        """Raises ValueError unless the files prove that texts can be cut, and that pieces give every text back.

        No token of either vocabulary holds a blank behind another character than white space, so no merge reaches across
        a cut; A's own pattern always cuts there. B is asked for every code point but the mark, as what a text loses it
        loses by character.
        """
        spec = json.loads(self.a.to_str())
        step = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or (step.get("type"), step.get("use_regex"), step.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("A is no plain byte-level BPE")
        across = re.compile(f"[^{''.join(sorted(_SPACES))}] ")
        if any(across.search(x.decode(errors="replace")) for x in (*self.bytes_a, *self.bytes_b)):
            raise ValueError("a token reaches across a blank")
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and i != 0x2581)
        if b"".join(self.bytes_b[i] for i in self.b.encode(every)) != b" " + every.encode():
            raise ValueError("B does not give every text back")

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of segments (without the blank before each): the numbers of A's and B's tokens, the groups as text, the links
        (A's id times B's size, plus B's id) in a row, and the number of links of each segment."""
        spaced = [" " + s for s in segments]
        per_a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        per_b = self.b.encode(segments, num_threads=1) if segments else []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (per_a, per_b))
        ids_a, ids_b = (np.fromiter((i for x in per for i in x), np.int64, int(n.sum())) for per, n in ((per_a, n_a), (per_b, n_b)))
        want = "".join(spaced).encode()
        if b"".join([self.bytes_a[i] for i in ids_a]) != want or b"".join([self.bytes_b[i] for i in ids_b]) != want:
            raise AssertionError("tokens don't give a segment back, against what verify() has shown")
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        _, in_a, in_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        links = ids_a[in_a] * len(self.bytes_b) + ids_b[in_b]
        n_links = np.diff(np.searchsorted(in_a, np.concatenate([[0], np.cumsum(n_a)]), "left"))
        text_a, text_b = (list(map(str, x.tolist())) for x in (ids_a, ids_b))
        groups, x, y = [], 0, 0
        for i, j in zip((in_a + 1).tolist(), (in_b + 1).tolist(), strict=True):
            groups.append(f"{','.join(text_a[x:i])}|{','.join(text_b[y:j])}")
            x, y = i, j
        stop = np.cumsum(n_links).tolist()
        return n_a, n_b, [";".join(groups[s:e]) for s, e in zip([0, *stop[:-1]], stop, strict=True)] if stop else [], links, n_links


def segments_of(text: str) -> list[str]:
    """The segments of a text that isn't empty, each without the blank before it: cut at blanks that follow no white space
    and aren't the last character."""
    out, held = [], None
    for part in text.split(" "):
        if held is None:
            held = part
        elif not held or held[-1] in _SPACES:
            held += " " + part
        else:
            out.append(held)
            held = part
    if held or not out:
        return [*out, held]
    return [*out[:-1], out[-1] + " "]


def _collect(chunk_bytes: int):
    """docs -> a row for each document (its segments' numbers in its chunk) and one for each chunk (its segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", chunk_bytes):
            text = strings(batch.column("text"))
            none = pc.or_(pc.equal(text, ""), pc.match_substring(text, MARK))
            uneven = pc.and_(pc.match_substring_regex(text, UNEVEN), pc.invert(none))
            plain = pc.invert(pc.or_(none, uneven))
            cut = pc.split_pattern(text.filter(plain), " ")
            odd = [segments_of(t) for t in text.filter(uneven).to_pylist()]
            flat = pa.concat_arrays([cut.flatten().cast(pa.large_string()), pa.array([s for x in odd for s in x], pa.large_string())]).dictionary_encode()
            sizes = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), np.array([len(x) for x in odd], np.int64)]).astype(np.int64)
            at = np.ascontiguousarray(flat.indices.to_numpy(), "<u4")
            stops = np.cumsum(sizes)
            packed = [pa.compress(at[e - n : e].tobytes(), "zstd", asbytes=True) for n, e in zip(sizes.tolist(), stops.tolist(), strict=True)]
            ids = batch.column("doc_id")
            ids = pa.concat_arrays([ids.filter(plain), ids.filter(uneven), ids.filter(none)])
            n = len(ids)
            counts = np.bincount(at, minlength=len(flat.dictionary)).astype(np.int64)
            one = lambda values, kind: pa.array([None] * n + [values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, chunk, np.int64)),
                    pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                    pa.array([*sizes.tolist(), *[0] * (n + 1 - len(sizes))], pa.int64()),
                    pa.array([*packed, *[None] * (n + 1 - len(packed))], pa.binary()),
                    one(flat.dictionary.cast(pa.string()).to_pylist(), pa.string()),
                    one(counts.tolist(), pa.int64()),
                ],
                names=["chunk", "doc_id", "size", "at", "segments", "counts"],
            )
            chunk += 1

    return run


def _align(a: str, b: str):
    """Occurrences in the order of their segments -> the same with their alignment, and counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a, b)
        last, before = None, None  # the segment that the last batch ended with, and its row
        keys, numbers = [], []

        def counted() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, np.concatenate(numbers))
            keys[:], numbers[:] = [key], [n]
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64()), pa.array(n), pa.array(key), *[pa.nulls(len(key), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())]], names=ALIGNED)

        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                segment = batch.column("segment").to_pylist()
                new = np.array([x != y for x, y in zip(segment, [last, *segment[:-1]], strict=True)])
                row = np.cumsum(new)  # 0: the last batch's
                n_a, n_b, groups, links, n_links = pair.align([s for s, k in zip(segment, new.tolist(), strict=True) if k])
                own = pa.RecordBatch.from_arrays([pa.array(n_a), pa.array(n_b), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), pa.array(links)), pa.array(groups, pa.string())], names=ALIGNED[4:])
                if before is None:
                    before = pa.RecordBatch.from_arrays([pa.nulls(1, c.type) for c in own.columns], names=ALIGNED[4:])
                known = pa.Table.from_batches([before, own]).combine_chunks()
                out = known.take(pa.array(row))
                lists = out.column("links").combine_chunks() if isinstance(out.column("links"), pa.ChunkedArray) else out.column("links")
                keys.append(lists.flatten().to_numpy(zero_copy_only=False))
                numbers.append(np.repeat(batch.column("n").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
                if sum(map(len, keys)) > 50 * STEP:
                    counted()
                    if len(keys[0]) > 25 * STEP:
                        yield counted()
                        keys.clear(), numbers.clear()
                last, before = segment[-1], known.slice(len(known) - 1).to_batches()[0]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("pos"), batch.column("n"), pa.nulls(batch.num_rows, pa.int64()), *columns], names=ALIGNED)
        if keys:
            yield counted()

    return run


ALIGNED = ["chunk", "pos", "n", "key", "n_a", "n_b", "links", "groups"]
ALIGNED_TYPES = "chunk bigint, pos bigint, n bigint, key bigint, n_a bigint, n_b bigint, links array<bigint>, groups string"


def _score(table):
    """Looks links up in a broadcast table (keys in order, counts, whether best): n_best and count_sum of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for batch in batches:
            links = batch.column("links")
            at = np.searchsorted(keys, links.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy(zero_copy_only=False))])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at].astype(np.int64))])[ends])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("chunk", "pos", "n_a", "n_b")], pa.array(np.diff(ends)), pa.array(total(best)), pa.array(total(counts)), batch.column("groups")], names=SCORED)

    return run


SCORED = ["chunk", "pos", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups"]
PACKED = "chunk bigint, n bigint, pack binary"


#: Of a pack: the columns with four bytes a row; count_sum has eight; then the bytes of all groups.
NARROW = ["pos", "n_a", "n_b", "n_links", "n_best", "length"]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored occurrences -> one row for each chunk in a batch: n, and the columns of its n rows as bytes, compressed if
    there are many."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("chunk")))
        columns = {c: batch.column(c).to_numpy() for c in SCORED[:-1]}
        groups = batch.column("groups").cast(pa.binary())
        columns["length"] = pc.binary_length(groups).to_numpy()
        text, ends = b"".join(groups.to_pylist()), np.concatenate([[0], np.cumsum(columns["length"])]).tolist()
        chunk = columns["chunk"]
        first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
        stop = np.concatenate([first[1:], [len(chunk)]])[: len(first)]
        packs = []
        for s, e in zip(first.tolist(), stop.tolist(), strict=True):
            raw = b"".join([*[columns[c][s:e].astype("<u4").tobytes() for c in NARROW], columns["count_sum"][s:e].astype("<i8").tobytes(), text[ends[s] : ends[e]]])
            packs.append(raw if e - s < 8 else len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(stop - first), pa.array(packs, pa.binary())], names=["chunk", "n", "pack"])


def _unpack(n: np.ndarray, packs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all packs' rows, and their groups, in the order of pos."""
    raws = [x if k < 8 else pa.decompress(x[4:], int.from_bytes(x[:4], "little"), "zstd", asbytes=True) for k, x in zip(n.tolist(), packs, strict=True)]
    column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(raws, n.tolist(), strict=True)] or [np.zeros(0, kind)]).astype(np.int64)
    out = {c: column("<u4", 4 * i) for i, c in enumerate(NARROW)}
    out["count_sum"] = column("<i8", 4 * len(NARROW))
    wide = 4 * len(NARROW) + 8
    text = b"".join([x[wide * k :] for x, k in zip(raws, n.tolist(), strict=True)])
    offsets = np.concatenate([[0], np.cumsum(out["length"])])
    groups = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(text))
    order = np.argsort(out["pos"])
    return {c: out[c][order] for c in SCORED[2:7]}, np.array(groups.to_pylist(), object)[order]


def _compose(docs: pa.Table, packs: pa.Table) -> pa.Table:
    """The documents of a chunk from the rows of its segments."""
    sums, groups = _unpack(packs.column("n").to_numpy(), packs.column("pack").to_pylist())
    out, digests = np.zeros((5, len(docs)), np.int64), [""] * len(docs)
    for i, (n, packed) in enumerate(zip(docs.column("size").to_pylist(), docs.column("at").to_pylist(), strict=True)):
        if packed is not None:
            at = np.frombuffer(pa.decompress(packed, 4 * n, "zstd"), "<u4")
            out[:, i] = [x[at].sum() for x in sums.values()]
            digests[i] = hashlib.sha256(";".join(groups[at].tolist()).encode()).hexdigest()
    a, b, links, best, count = map(pa.array, out)
    return pa.table([docs.column("doc_id"), a, b, links, links, best, count, pa.array(digests, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """key (A's id times B's size, plus B's id), count (long) over the corpus, and best: whether no other pair of B's id
    has more."""
    counts = aligned.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("key", F.lit(size_b)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a: str, b: str, chunk_bytes: int = CHUNK_BYTES, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id and, of each row's text, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    A encodes a blank and the text, B the text, to which it adds the blank. Byte offsets at which tokens of both end part
    groups; a link is a pair of an A and a B token that end at the same offset, so there is one a group. A pair's count is
    the number of its links in all documents; n_best counts links whose pair is the most frequent of its B id (ties
    count), count_sum adds the counts of a document's links. groups_sha256 is the hash of the groups' ids as text.

    Null and empty texts, and those that the piece model can't give back (they hold U+2581), have no tokens: zeros, and
    the empty string. Repeated rows are counted and returned as rows; an empty table gives no rows. A text of any length
    is cut; a segment without blanks is one piece of work.

    Each chunk of texts hands in its distinct segments with their numbers, so a segment that all documents hold travels
    once a chunk. Occurrences meet in the order of their segments, each of which is tokenised once; they go back to
    their chunks in packs, where documents are composed. Counts of pairs go to every task if there are most_pairs at
    most, else they are joined. The files are verified before anything runs.
    """
    pair = Pair.of(a, b)
    pair.verify()
    size_b = len(pair.bytes_b)
    spark, kind, scratch = docs.sparkSession, dict(docs.dtypes)["doc_id"], Scratch(docs.sparkSession, "crosstok")
    rows = docs.select("doc_id", "text").mapInArrow(_collect(chunk_bytes), f"chunk bigint, doc_id {kind}, size bigint, at binary, segments array<string>, counts array<bigint>")
    rows = scratch.save(rows, "chunks", compression="zstd")
    held = rows.where("segments IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("segments", "counts")).alias("pos", "s"))
    held = held.select("chunk", F.col("pos").cast("long").alias("pos"), F.col("s.segments").alias("segment"), F.col("s.counts").alias("n"))
    held = held.repartition(F.xxhash64("segment")).sortWithinPartitions("segment")
    aligned = scratch.save(held.select("chunk", "pos", "n", "segment").mapInArrow(_align(a, b), ALIGNED_TYPES), "aligned", compression="zstd")
    pairs = scratch.save(pair_counts(aligned, size_b), "pairs")
    found = aligned.where("key IS NULL")
    if pairs.count() <= most_pairs:
        table = pairs.orderBy("key").toArrow()
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "count", "best")))
        score = _score(sent)
        packs = found.select("chunk", "pos", "n_a", "n_b", "links", "groups").mapInArrow(lambda batches: _packs(score(batches)), PACKED)
    else:
        each = found.select("links").distinct().select("links", F.explode("links").alias("key")).join(pairs, "key")
        totals = each.groupBy("links").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        scored = found.join(totals, "links").select("chunk", "pos", "n_a", "n_b", F.size("links").cast("long").alias("n_links"), "n_best", "count_sum", "groups")
        packs = scored.mapInArrow(_packs, PACKED)
    texts = rows.where("segments IS NULL").select("chunk", "doc_id", "size", "at")
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return texts.groupBy("chunk").cogroup(packs.groupBy("chunk")).applyInArrow(_compose, schema)
