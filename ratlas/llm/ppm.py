"""Prediction by partial matching over bytes: a context trie counted over the corpus, and code lengths of texts.

A text is a start sign, its lower-cased words, each followed by a blank, and an end sign. A byte is predicted from up to
ORDER bytes before it, over blanks and the words before, back to the start of the text. Escapes are those of method C with
symbol exclusion: in a context that was followed n times, by d different symbols, a symbol seen c times has c / (n + d)
and the escape d / (n + d); after an escape, symbols of the longer context are excluded from the shorter one.

An event is a context with the symbol after it; a trie is a table of events and counts. Texts are dealt into chunks whose
distinct events (and words, for the word model beside it) travel, packed, to the part of their context's hash, which sums
their counts and knows every longest context whole. There all events that the corpus holds get their scores. Those that it
doesn't hold escape from order to order, by joins with tables of contexts. The scores go back to the chunks.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch, slices, split_words, strings

#: Bytes of context at most; a context, its length and a symbol fit into one long.
ORDER = 6
#: Bytes of running text whose distinct events are counted, and get their scores, together.
CHUNK_BYTES = 24 << 20
#: Bytes of running text that are turned into events at once: an event takes many times the memory of its byte.
WINDOW_BYTES = 1 << 19
#: Most parts into which events are dealt. They grow with the texts up to here: distinct events grow far less than texts.
PARTS = 4096
START, BLANK, END = "\x01", " ", "\n"
#: Kinds of packs.
EVENTS, WORDS = 0, 1
_HELD = 1 << 62


def _bits(n: int) -> np.int64:
    return np.int64((1 << 8 * n) - 1)


class Stream:
    """The running bytes of texts, one after the other, and their words."""

    def __init__(self, text: pa.Array):
        words, n = split_words(pc.ascii_lower(strings(text)))
        self.n_words = np.asarray(n, np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n_words)]), pa.int64()), words)
        ends = pa.array([END, BLANK + END], pa.large_string()).take(pa.array((self.n_words > 0).astype(np.int64)))
        data = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), pc.binary_join(lists, pa.scalar(BLANK, pa.large_string())), ends, pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        self.flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8)
        self.start = offsets[:-1] - offsets[0]
        self.size = np.diff(offsets)
        coded = words.dictionary_encode()
        #: hashes of the distinct words (64 bits: among a billion words no two are expected to share one), and each word's place
        self.words = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64)
        self.places = coded.indices.to_numpy()

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Events of all texts, in order and window by window, with the text of each: symbol, context, context length."""
        for a in range(0, len(self.flat), WINDOW_BYTES):
            b, low = min(a + WINDOW_BYTES, len(self.flat)), max(0, a - ORDER)
            flat = self.flat[low:b].astype(np.int64)
            key = flat | (ORDER << 56)
            for d in range(1, ORDER + 1):
                key[d:] |= flat[:-d] << 8 * d
            first, last = np.searchsorted(self.start, (low, b))  # texts that start in the window
            start, size = self.start[first:last] - low, self.size[first:last]
            for place in range(1, ORDER):  # contexts that end at the start of the text
                at = start[size > place] + place
                at = at[at < len(key)]
                key[at] = key[at] & _bits(place + 1) | place << 56
            real = np.ones(len(key), bool)
            real[: a - low] = False
            real[start] = False
            inner = self.start[np.searchsorted(self.start, a, side="right") : last]
            bounds = np.concatenate([[a], inner, [b]])
            doc = np.repeat(last - len(inner) - 1 + np.arange(len(bounds) - 1), np.diff(bounds))
            yield key[real], doc[real[a - low :]]


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[new], np.add.reduceat(count, new) if len(new) else count


class Tally:
    """Distinct keys with counts, summed up whenever as many wait as are held."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.held = [], [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(1 << 19, self.held // 2):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, count = _sum_up(self.keys, self.counts)
        self.keys, self.counts, self.waiting, self.held = [key], [count], 0, len(key)
        return key, count


def _pack(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed, after how many they are."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    n, wide = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * wide, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(wide, n).T.copy().view(kind).ravel()


def _pack_scores(values: np.ndarray) -> bytes:
    """Few scores are different: the distinct ones, and the number of each."""
    distinct, at = np.unique(values, return_inverse=True)
    first = _pack(distinct)
    return len(first).to_bytes(8, "little") + first + _pack(at.astype("<u4"))


def _unpack_scores(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return _unpack(data[8:end], "f4")[_unpack(data[end:], "u4")]


def _let_go() -> None:
    """Give freed memory back to the system: a worker lives on and runs other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "i8"))


def _part_of(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """The part of words, and of events by their context, so that a part holds longest contexts whole."""
    node = (keys >> 8 if kind == EVENTS else keys).astype(np.uint64)
    return ((node * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _pack_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack_rows(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as source:
        return source.read_next_batch()


def _chunks(parts: int, chunk_bytes: int, kind: pa.DataType):
    """Packs of rows as they are, with the number of their chunk; and for each chunk and part its distinct events, or words,
    with their counts in texts to learn from."""
    names = ["chunk", "rows", "kind", "part", "keys", "counts"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def packs(chunk: int, what: int, tally: Tally) -> pa.RecordBatch:
        key, count = tally.sums()
        part = _part_of(key, what, parts)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        key, count, spans = key[order], count[order], list(zip(first, [*first[1:], len(key)], strict=False))
        own = [pa.array(np.full(len(found), chunk)), pa.nulls(len(found), pa.binary()), pa.array(np.full(len(found), what, np.int32)), pa.array(found)]
        return pa.RecordBatch.from_arrays([*own, pa.array([_pack_keys(key[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(count[a:b]) for a, b in spans], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        chunk, held, tallies = first, 0, (Tally(), Tally())
        for batch in slices(batches, "text", WINDOW_BYTES):
            stream, out = Stream(batch.column("text")), batch.column("held_out").to_numpy(zero_copy_only=False)
            if held and held + len(stream.flat) > chunk_bytes:
                yield packs(chunk, EVENTS, tallies[EVENTS])
                yield packs(chunk, WORDS, tallies[WORDS])
                _let_go()
                chunk, held, tallies = chunk + 1, 0, (Tally(), Tally())
            held += len(stream.flat)
            for key, doc in stream.windows():
                if out.any():
                    key = key | np.where(out, _HELD, 0)[doc]
                key = np.sort(key)
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                count, key = np.diff(np.append(new, len(key))), key[new]
                count[key >= _HELD] = 0
                tallies[EVENTS].add(key & ~_HELD, count)
            learnt = np.bincount(stream.places[np.repeat(~out, stream.n_words)], minlength=len(stream.words))
            tallies[WORDS].add(stream.words, learnt)
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kind), batch.column("held_out"), batch.column("text").cast(pa.string())], names=["doc_id", "held_out", "text"])
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((chunk, _pack_rows(rows), None, None, None, None), kinds, strict=True)], names=names)
        if held:
            yield packs(chunk, EVENTS, tallies[EVENTS])
            yield packs(chunk, WORDS, tallies[WORDS])
        del tallies
        _let_go()

    return run


MERGED = "kind int, part bigint, keys binary, scores binary, n bigint, v bigint, event bigint, sofar double, seen binary, level int, context bigint, symbol int, c bigint"
_MERGED = {"kind": pa.int32(), "part": pa.int64(), "keys": pa.binary(), "scores": pa.binary(), "n": pa.int64(), "v": pa.int64(), "event": pa.int64(), "sofar": pa.float64(), "seen": pa.binary(), "level": pa.int32(), "context": pa.int64(), "symbol": pa.int32(), "c": pa.int64()}


def _rows(n_rows: int, **columns) -> pa.RecordBatch:
    """Rows of MERGED with these columns; a single value stands for all rows."""
    full = lambda v, t: v if isinstance(v, pa.Array) else pa.array(v, t) if isinstance(v, (np.ndarray, list)) else pa.array([v] * n_rows, t)
    return pa.RecordBatch.from_arrays([full(columns[k], t) if k in columns else pa.nulls(n_rows, t) for k, t in _MERGED.items()], names=list(_MERGED))


def _score_longest(part: int, event: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All events of a part: scores of those that the corpus holds after ORDER bytes (NaN: still open); the open ones, with
    what their escape costs and the symbols it excludes; and the counts that shorter contexts take over."""
    length, symbol = (event >> 56).astype(np.int32), (event & 255).astype(np.int32)
    full, seen = length == ORDER, count > 0
    node, at = np.unique(event >> 8, return_inverse=True)
    n, d = np.bincount(at, count, len(node)), np.bincount(at, seen, len(node))
    score = np.full(len(event), np.nan, np.float32)
    hit = full & seen
    score[hit] = np.log10(count[hit] / (n + d)[at[hit]])
    yield _rows(1, kind=EVENTS, part=part, keys=[_pack_keys(event)], scores=[_pack_scores(score)])
    rest = np.flatnonzero(~hit)
    sofar = np.zeros(len(rest))
    known = full[rest] & (d[at[rest]] > 0)
    inner = at[rest[known]]
    sofar[known] = np.log10(d[inner] / (n + d)[inner])
    excluded = [b""] * len(rest)
    order = np.flatnonzero(hit)  # sorted by context, so a context's symbols lie in a row
    first, data = np.searchsorted(at[order], inner), symbol[order].astype(np.uint8).tobytes()
    last = np.searchsorted(at[order], inner, side="right")
    for i, a, b in zip(np.flatnonzero(known).tolist(), first.tolist(), last.tolist(), strict=True):
        excluded[i] = data[a:b]
    level = np.where(full[rest], ORDER - 1, length[rest])
    yield _rows(len(rest), kind=EVENTS, part=part, event=event[rest], sofar=sofar, seen=excluded, level=level)
    for k in range(1, ORDER):  # ORDER - 1: those that end at the start of a text, and what longer contexts hand down
        use = seen & (length == k)
        if k == ORDER - 1:
            use |= hit
        key, c = _sum_up([event[use] & _bits(k + 1)], [count[use]])
        yield _rows(len(key), kind=EVENTS, level=k, context=key >> 8, symbol=key & 255, c=c)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs, sorted by part and kind -> MERGED."""
    here, tally = None, Tally()

    def close() -> Iterator[pa.RecordBatch]:
        key, count = tally.sums()
        if here[1] == EVENTS:
            yield from _score_longest(here[0], key, count)
        else:
            yield _rows(1, kind=WORDS, part=here[0], keys=[_pack_keys(key)], scores=[_pack(count)], n=int(count.sum()), v=int((count > 0).sum()))

    for batch in batches:
        for part, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "keys", "counts")), strict=True):
            if here != (part, kind):
                if here:
                    yield from close()
                here, tally = (part, kind), Tally()
            tally.add(_unpack_keys(keys), _unpack(counts, "i8"))
    if here:
        yield from close()


def _flags(column: pa.Array) -> np.ndarray:
    """A row of 256 for each value: whether the value, as bytes, holds the symbol (null: none)."""
    data = column.to_pylist()
    out = np.zeros((len(data), 256), bool)
    out[np.repeat(np.arange(len(data)), [len(x or b"") for x in data]), np.frombuffer(b"".join(x or b"" for x in data), np.uint8)] = True
    return out


def _escape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open events beside the symbols and counts of their context of this order -> scored, or open for the next order."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = batch.slice(at, 4096)
            nodes = pc.list_value_length(rows.column("node")).fill_null(0).to_numpy(zero_copy_only=False)
            flat = rows.column("node").flatten()
            table = np.zeros((rows.num_rows, 256), np.int64)
            table[np.repeat(np.arange(rows.num_rows), nodes), flat.field("symbol").to_numpy()] = flat.field("c").to_numpy()
            score, done = _step(rows.column("sofar").to_numpy(), table, _flags(rows.column("seen")), rows.column("event").to_numpy() & 255)
            data, ends = flat.field("symbol").to_numpy().astype(np.uint8).tobytes(), np.cumsum(nodes).tolist()
            seen = [data[e - n : e] if n else g for e, n, g in zip(ends, nodes.tolist(), rows.column("seen").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("event"), pa.array(score), pa.array(seen, pa.binary()), pa.array(done)], names=["part", "event", "sofar", "seen", "done"])


def _step(sofar: np.ndarray, table: np.ndarray, out: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after one order, and which events are done: those whose symbol the context holds."""
    left = np.where(out, 0, table)
    n, d, c = left.sum(1), (left > 0).sum(1), left[np.arange(len(left)), symbol]
    done, miss = c > 0, d > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        here = np.where(done, np.log10(c / (n + d)), np.where(miss, np.log10(d / (n + d)), 0.0))
    return sofar + here, done


def _shortest(first: np.ndarray):
    """Open events at order 1, by the counts of symbols after single bytes -> scored, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = first.sum(0)
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                rows = batch.slice(part, 4096)
                event = rows.column("event").to_numpy()
                out = _flags(rows.column("seen"))
                score, done = rows.column("sofar").to_numpy(), np.zeros(len(event), bool)
                for table in (first[event >> 8 & 255], np.broadcast_to(zero, (len(event), 256))):
                    new, hit = _step(score, table, out, event & 255)
                    score, out, done = np.where(done, score, new), out | (table > 0), done | hit
                score = score - np.where(done, 0, np.log10(np.maximum(1, 256 - out.sum(1))))
                yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("event"), pa.array(score)], names=["part", "event", "sofar"])

    return run


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By part and kind first its keys with scores, then those of its open events, then packs of chunks -> the packs with
    scores (events) or counts (words, whose keys stay behind: the chunk finds them again) in place of counts."""
    names, key, value = ["chunk", "kind", "part", "keys", "values"], np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        out: list[tuple] = []
        for i, row in enumerate(batch.select(["step", "kind", "part", "chunk", "keys", "scores"]).to_pylist()):
            if row["step"] == 0:
                key, value = _unpack_keys(row["keys"]), _unpack_scores(row["scores"]) if row["kind"] == EVENTS else _unpack(row["scores"], "i8")
            elif row["step"] == 1:
                value[np.searchsorted(key, batch.column("events")[i].values.to_numpy())] = batch.column("late")[i].values.to_numpy()
            else:
                found = value[np.searchsorted(key, _unpack_keys(row["keys"]))]
                out.append((row["chunk"], row["kind"], row["part"], *((row["keys"], _pack_scores(found)) if row["kind"] == EVENTS else (None, _pack(found)))))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def _values_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, all of which are among the sorted keys. They are sorted together with their places, by
    as many of their first bits as fit beside those; runs of equal ones are looked up once."""
    bits = len(wanted).bit_length()
    order = np.sort(wanted >> max(0, bits - 4) << bits | np.arange(len(wanted))) & ((1 << bits) - 1)
    wanted = wanted[order]
    new = np.flatnonzero(np.append(True, wanted[1:] != wanted[:-1])[: len(wanted)])
    out = np.empty(len(wanted), values.dtype)
    out[order] = np.repeat(values[np.searchsorted(keys, wanted[new])], np.diff(np.append(new, len(wanted))))
    return out


def _sum_texts(parts: int, end_count: int, total: int, distinct: int):
    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        mine = back.filter(pc.equal(back.column("kind"), EVENTS))
        event = np.concatenate([_unpack_keys(x) for x in mine.column("keys").to_pylist()])
        score = np.concatenate([_unpack_scores(x) for x in mine.column("values").to_pylist()])
        order = np.argsort(event)
        event = event[order]
        score = score[order]
        out, words = [], []
        for data in texts.column("rows").to_pylist():
            batch = _unpack_rows(data)
            stream, n = Stream(batch.column("text")), batch.num_rows
            sums = np.zeros(n)
            for key, doc in stream.windows():
                sums += np.bincount(doc, _values_at(event, score, key), n)
            out.append((batch.column("doc_id"), batch.column("held_out"), stream.n_words, sums))
            words.append((stream.words, stream.places))
        mine = back.filter(pc.equal(back.column("kind"), WORDS)).sort_by("part")
        word = np.unique(np.concatenate([w for w, _ in words]))
        count = np.zeros(len(word), np.int64)
        count[np.argsort(_part_of(word, WORDS, parts), kind="stable")] = np.concatenate([np.zeros(0, np.int64), *[_unpack(x, "i8") for x in mine.column("values").to_pylist()]])
        scale = math.log10(total + 0.1 * (distinct + 1))
        tables = []
        for (ids, held, n_words, sums), (keys, places) in zip(out, words, strict=True):
            n, c = len(sums), count[np.searchsorted(word, keys)][places]
            doc = np.repeat(np.arange(n), n_words)
            base = np.bincount(doc, np.log10(c + 0.1) - scale, n) + math.log10(end_count + 0.1) - scale
            known = np.bincount(doc, c > 0, n).astype(np.int64) + (end_count > 0)
            columns = [ids, held, pa.array(n_words + 1), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(sums)]
            tables.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        del event, score, order, out, words
        _let_go()
        return pa.Table.from_batches(tables)

    return run


def score_running(docs: DataFrame, held_percent: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of doc_id as text (null: empty) falls below held_percent / 10 modulo 10 are held out; the
    model learns from all others, whole. score is log10 of the probability that the trie gives to the text (null:
    empty, so the end sign alone); base_score is that of a smoothed word count. Equal texts have equal scores; repeated
    rows are learnt, and returned, as often as they occur. With no document to learn from, bytes are equally likely,
    train_tokens is 0 and no token is known. Other columns of docs are not read; an empty table gives no rows.

    What leaves a chunk is a pack for each part; a part's packs are summed one after the other, so a task holds the
    distinct events of a part or of a chunk, never all that chunks sent. No context, however frequent, meets in one task
    with more than its 256 symbols: open events are joined with their contexts, which Spark can split. Only counts of
    byte pairs (at most 65,536) and a row count come to the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 < held_percent // 10
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    n_train, size = rows.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = min(PARTS, max(32, size // CHUNK_BYTES))
    schema = "chunk bigint, rows binary, kind int, part bigint, keys binary, counts binary"
    both = scratch.save(rows.mapInArrow(_chunks(parts, chunk_bytes, arrow), schema), "chunks")
    packs = both.where("part IS NOT NULL").select("part", "kind", "chunk", "keys", "counts")
    merged = scratch.save(packs.repartition("part", "kind").sortWithinPartitions("part", "kind").mapInArrow(_merge, MERGED), "merged")

    opened = merged.where("event IS NOT NULL").select("part", "event", "sofar", "seen", "level")
    handed, now, done = merged.where("c IS NOT NULL"), None, []
    longer = handed.where("false").select("context", "symbol", "c")
    for k in range(ORDER - 1, 1, -1):
        own = handed.where(F.col("level") == k).select("context", "symbol", "c")
        counts = own.union(longer).repartition("context").groupBy("context", "symbol").agg(F.sum("c").alias("c"))
        counts = scratch.save(counts, f"counts-{k}")
        longer = counts.select(F.col("context").bitwiseAND(F.lit(int(_bits(k - 1)))).alias("context"), "symbol", "c")
        mine = opened.where(F.col("level") == k).drop("level")
        mine = (mine if now is None else mine.union(now)).withColumn("context", F.expr(f"(event >> 8) & {int(_bits(k))}L"))
        mine = scratch.save(mine, f"open-{k}")
        nodes = counts.join(mine.select("context").distinct(), "context", "left_semi")
        nodes = nodes.groupBy("context").agg(F.collect_list(F.struct("symbol", "c")).alias("node"))  # at most 256
        step = mine.join(nodes, "context", "left").select("part", "event", "sofar", "seen", "node")
        step = scratch.save(step.mapInArrow(_escape, "part bigint, event bigint, sofar double, seen binary, done boolean"), f"step-{k}")
        done.append(step.where("done").select("part", "event", "sofar"))
        now = step.where("NOT done").select("part", "event", "sofar", "seen")
        scratch.drop(f"open-{k}", f"counts-{k + 1}")
    single = handed.where("level = 1").select("context", "symbol", "c").union(longer).groupBy("context", "symbol").agg(F.sum("c").alias("c"))
    first = np.zeros((256, 256), np.int64)
    for r in single.collect():  # at most 256 times 256 rows
        first[r["context"] & 255, r["symbol"]] = r["c"]
    last = opened.where("level = 1").drop("level").union(now)
    done.append(last.mapInArrow(_shortest(first), "part bigint, event bigint, sofar double"))

    late = done[0]
    for d in done[1:]:
        late = late.union(d)
    late = late.groupBy("part").agg(F.collect_list(F.struct("event", "sofar")).alias("x")).select("part", F.lit(EVENTS).alias("kind"), F.lit(1).alias("step"), F.col("x.event").alias("events"), F.col("x.sofar").alias("late"))
    table = merged.where("keys IS NOT NULL").select("part", "kind", F.lit(0).alias("step"), "keys", "scores")
    asked = packs.select("part", "kind", F.lit(2).alias("step"), "chunk", "keys")
    flow = asked.unionByName(table, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    back = flow.repartition("part", "kind").sortWithinPartitions("part", "kind", "step").mapInArrow(_give_back, "chunk bigint, kind int, part bigint, keys binary, values binary")

    n_words, n_distinct = merged.where("v IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)
    texts = both.where("part IS NULL").select("chunk", "rows")
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_sum_texts(parts, n_train, total, distinct), out)
