"""Token ids: a fast way through the tokenizers library, Parquet token files, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch, slices, split_words, strings

#: Pieces, and code points of pieces, whose ids a worker remembers; beyond that it starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 32 << 20
#: What the shortcut for words knows. Normalisers that never act across white space, and patterns that drop
#: white space and always cut between a letter or digit and a mark of WordTokenizer.CUT.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
PATTERNS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
_memories: dict[str, WordTokenizer] = {}


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer file's own definitions prove that a text's ids are those of its words in a row."""
    normal = (spec.get("normalizer") or {}).get("normalizers")
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut, rest = steps[0], steps[1:]
    return (
        normal == list(NORMALIZERS)
        and cut.get("type") == "Split"
        and cut.get("pattern", {}).get("Regex") in PATTERNS
        and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and not any(x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
    )


class WordTokenizer:
    """A tokenizer file of the library; each distinct piece of text is encoded once and then remembered.

    The pieces are words between white space if the file proves that they can be encoded alone (splits_at_space): no
    normalisation reaches across a blank and no token holds one. Words of code points below U+0300, without U+0130, are
    also lower-cased (A-Z) and cut before marks that follow a letter or digit: nothing in them is composed or taken
    apart, so the file's own normaliser and pattern come to the same. All other words reach the library as they are.
    Texts that spell a special token, and all texts of any other file, go to the library whole.
    """

    #: Between a letter or digit and one of these marks the file's own pattern always cuts.
    CUT = r"([\pL\pN])([.,;:!?%&$#*|]+)"
    #: Code points that normalisation leaves alone and whose lower case is one letter.
    PLAIN = r"^[\x00-\x{12F}\x{131}-\x{2FF}]*$"

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.by_word = splits_at_space(json.loads(self.tool.to_str()))
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The worker's own for a file."""
        if path not in _memories:
            _memories[path] = cls(path)
        return _memories[path]

    def _forget(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)  # of piece i's ids; they start at ends[i - 1]
        self.n = self.chars = 0

    def _learn(self, pieces: list[str]) -> None:
        found = [x.ids for x in self.tool.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        start = self.ends[self.n - 1] if self.n else 0
        ends = start + np.cumsum(sizes)
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < self.n + len(pieces):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[start : ends[-1]] = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        self.ends[self.n : self.n + len(pieces)] = ends
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.n += len(pieces)
        self.chars += sum(map(len, pieces))

    def _place(self, pieces: list[str]) -> np.ndarray:
        """The number of each of the distinct pieces, which are learnt if they are new."""
        if self.n + len(pieces) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        if new := [w for w in pieces if w not in self.known]:
            self._learn(new)
        return np.fromiter((self.known[w] for w in pieces), np.int64, len(pieces))

    def encode(self, text: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (int32), each text's followed by end, and the number of ids of each text."""
        text = strings(text)
        whole = np.full(len(text), not self.by_word)
        for t in self.special:
            whole |= pc.match_substring(text, t).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", text) if whole.any() else text
        words, n_words = split_words(plain)
        words = words.dictionary_encode()
        distinct = words.dictionary
        simple = pc.match_substring_regex(distinct, self.PLAIN)
        cut = pc.replace_substring_regex(pc.ascii_lower(distinct), self.CUT, r"\1 \2")
        pieces, n_pieces = split_words(pc.if_else(simple, cut, distinct))
        pieces = pieces.dictionary_encode()
        at = self._place(pieces.dictionary.to_pylist())
        at = at[pieces.indices.to_numpy()] if len(at) else at
        # pieces of a distinct word lie in a row, so its ids are gathered once, then those of every occurrence
        ids, size = self._gather(at)
        total = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(n_pieces)
        first, last = total[stop - n_pieces], total[stop]
        which = words.indices.to_numpy()
        begin, size = (first[which], (last - first)[which]) if len(which) else (which, which)
        ids = ids[_ranges(begin, size)]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(n_words)
        counts = total[ends] - total[ends - n_words]
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(whole):
                parts[i] = np.array(self.tool.encode(text[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), end).astype(np.int32)
            counts = counts + 1
        return ids, counts

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        begin = np.where(at > 0, self.ends[at - 1], 0)
        size = self.ends[at] - begin
        return self.ids[_ranges(begin, size)], size


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... (size[0] of them), begin[1] ... as indices."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _encode(path: str, end: int | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = WordTokenizer.of(path), 0
        for batch in slices(batches, "text"):
            ids, counts = tool.encode(batch.column("text"), end)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            columns = [batch.column(n) for n in names]
            rows = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*columns, rows, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[*names, "row", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode whole texts (null: empty) and write Parquet files whose order of files and rows is that of doc_id.

    Columns: doc_id, part (number of the file), row (place in the file), n_tokens, tokens (list of int). tokens takes
    dictionary pages and, past their limit, delta encoding; doc_id, part, row and n_tokens delta encoding. Row groups
    and pages are small enough that page indexes let a reader skip to a few documents; column chunks keep metadata
    readable without the ids. Texts are dealt by range before they are encoded. Rows with one doc_id may go to several
    neighbouring files (a third column deals them), null doc_ids first. An empty table writes files without rows.
    """
    tie = F.rand(7)
    placed = docs.select("doc_id", "text", tie.alias("__tie")).repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = placed.mapInArrow(_encode(tokenizer, end, ["doc_id", "part"]), f"doc_id {kind}, part int, row bigint, n_tokens bigint, tokens array<int>")
    rows.write.options(
        **{
            "parquet.block.size": row_group_bytes,
            "parquet.page.size": page_bytes,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#tokens.list.element": "true",
            "parquet.page.write-checksum.enabled": "true",
            "compression": "zstd",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint", tokens: bool = True) -> DataFrame:
    """What write_tokens wrote; without tokens only the metadata columns are read."""
    df = spark.read.schema(f"doc_id {kind}, part int, row bigint, n_tokens bigint, tokens array<int>").parquet(path)
    return df if tokens else df.drop("tokens")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets, ids = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "part", "row")], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Per document of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts of files come from a read of the metadata alone and one running sum over files; inside a file the
    running sum follows its rows.
    """
    rows = read_tokens(spark, path, kind).select("doc_id", "part", "row", "tokens").mapInArrow(_digests, f"doc_id {kind}, part int, row bigint, n_tokens bigint, ids_crc32 bigint")
    sums = read_tokens(spark, path, kind, tokens=False).groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = sums.select(F.col("part").alias("__part"), F.coalesce(F.sum("held").over(before(Window.orderBy("part"))), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("row"))), F.lit(0))
    rows = rows.withColumn("__inside", inside).join(files, F.col("part") == F.col("__part"))
    return rows.select("doc_id", (F.col("__start") + F.col("__inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end: int | None = 2) -> DataFrame:
    """Write docs' token files to the shared folder and read their digests back."""
    path = f"{Scratch(docs.sparkSession, 'tokens').path}/tokens"
    write_tokens(docs, path, tokenizer, end)
    return token_digests(docs.sparkSession, path, dict(docs.dtypes)["doc_id"])
