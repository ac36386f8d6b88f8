"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.tokens import WordTokenizer

#: Bytes of text that one randomised group holds on average.
GROUP_BYTES = 2 << 20


class FirstFit:
    """A tournament tree over bins: each inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Place an item in the first bin that has room for it; there must be one."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        at, i = i - self.leaves, i // 2
        while i:
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return at


def pack_sizes(sizes: list[int], capacity: int, least_cut: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of these sizes.

    A document's full multiples of the capacity fill sequences alone. The rests are placed by first-fit decreasing,
    larger first, ties in order. Gaps that then remain are filled from the emptiest sequences, whose pieces are cut to
    size; a cut is made only if both of its sides keep least_cut ids, so no document is ground to crumbs. Sizes of 0
    give no piece.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(sizes):
        full = n // capacity
        out += [[(d, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rests.append((d, full * capacity, n % capacity))
    rests.sort(key=lambda x: -x[2])
    tree, bins = FirstFit(len(rests), capacity), []
    for piece in rests:
        at = tree.put(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: -fill[i])
    gaps = [i for i in order if capacity - fill[i] >= least_cut]
    # the emptiest gives, the fullest takes, until they meet
    lo, hi = 0, len(gaps) - 1
    while lo < hi:
        taker, giver = gaps[lo], gaps[hi]
        room = capacity - fill[taker]
        d, start, n = bins[giver][-1]
        take = min(room, n)
        if take < n and n - take < least_cut:
            take = n - least_cut
        if room < least_cut or take < min(least_cut, n):
            lo += 1
            continue
        bins[giver].pop()
        if take < n:
            bins[giver].append((d, start + take, n - take))
        bins[taker].append((d, start, take))
        fill[taker] += take
        fill[giver] -= take
        if not bins[giver]:
            hi -= 1
    return out + [b for b in bins if b]


def _pack(tokenizer: str, end: int, capacity: int, kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        tool = WordTokenizer.of(tokenizer)
        group = group.sort_by([("doc_id", "ascending"), ("__tie", "ascending")]).combine_chunks()  # a group that is run again packs alike
        ids, counts = tool.encode(group.column("text").combine_chunks(), end)
        base = np.cumsum(counts) - counts
        doc_ids, number = group.column("doc_id").combine_chunks(), group.column("__group")[0].as_py()
        pieces = [(d, s, n, q, o) for q, seq in enumerate(pack_sizes(counts.tolist(), capacity)) for (d, s, n), o in zip(seq, np.cumsum([0, *[p[2] for p in seq]]).tolist(), strict=False)]
        doc, start, length, seq, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        at = base[doc] + start
        raw = ids.astype("<u4")
        data = [raw[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = {"doc_id": doc_ids.take(pa.array(doc)).cast(kind), "start": start, "length": length, "ids": pa.array(data, pa.binary()), "doc_tokens": counts[doc], "sequence_id": number * (1 << 32) + seq, "offset": offset}
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and one end id. Groups are drawn by a hash of doc_id and of the
    row's place in its partition, so repeated rows and null doc_ids spread like all others; docs should be a table, whose
    rows keep their places if a task is run again. A group holds group_bytes of text on average; each is packed alone, so
    a group's task is bounded and the only shuffle deals the texts by group. Inside a group rows stand by doc_id (null
    last) and a hash of the text. Repeated rows are packed as often as they occur. A document longer than a group is a
    row like any other and is cut into sequences. At most one sequence a group stays partly filled, besides gaps too
    small to cut for. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-held // group_bytes))
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", F.monotonically_increasing_id()), F.lit(groups))
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", "text", place.alias("__group"), F.xxhash64("text").alias("__tie"))
    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.groupBy("__group").applyInArrow(_pack(tokenizer, end, capacity, to_arrow_type(kind)), schema)
