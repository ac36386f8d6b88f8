"""Token files, packing and archives: exact round trips."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratlas.llm import packing, tokens, warc
from ratlas.llm.queries import tokenizer_path

TEXTS = ["Hello, world! it's 5% of A.B.", None, "", " \n ", "<|endoftext|> und <|ENDOFTEXT|>", "É́à. Σίσυφος ΣΑΣ x y", "'ll, don't 's.'s 12.5", "wort " * 3000 + "ende", "Hello, world!"]


@pytest.fixture(scope="module")
def tool():
    return tokens.WordTokenizer(tokenizer_path())


def whole(tool, text, end):
    return tool.tool.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoding_equals_the_library(tool):
    data = pa.array(["x"] * 3 + TEXTS).slice(3)  # a slice, as batches come
    ids, counts = tool.encode(data, 2)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [whole(tool, t, 2) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBéΣß1 .,'s!?%|\n\t <>~`́中"), max_size=25), max_size=4))
def test_encoding_of_odd_texts(tool, texts):
    ids, counts = tool.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in tool.tool.encode(t, add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


def test_encoding_over_all_of_unicode(tool):
    rnd = random.Random(3)
    odd = [0x95F, 0x9DF, 0x95C, 0x958, 0x9DC, 0xA33, 0xFB1D, 0x2ADC, 0x1D15E, 0x212B, 0x130, 0x131, 0x1E9E, 0x345, 0x3A3, 0x3C2, 0xAC00, 0x1100, 0x1161, 0x85, 0xA0, 0x2028, 0x3000, 0x1C, 0x200B]
    marks = [0x300, 0x301, 0x308, 0x30C, 0x331, 0x327, 0x307, 0x323, 0x93C, 0x9BC, 0x5BC, 0x3099]

    def char():
        kind = rnd.choice("aaasmolu")
        if kind == "u":
            return chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)]))
        return chr({"a": rnd.randrange(33, 127), "s": ord(rnd.choice(" \t\n\r\x0b\x0c")), "m": rnd.choice(marks), "o": rnd.choice(odd), "l": rnd.randrange(0xA1, 0x300)}[kind])

    texts = ["".join(char() for _ in range(rnd.randrange(25))) for _ in range(20_000)] + ["H\u0331ello T\u0308 J\u030c", "\u095f, \u09df. \u095c."]
    ids, counts = tool.encode(pa.array(texts))
    assert tool.by_word
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == tool.tool.encode(text, add_special_tokens=False).ids, ascii(text)


def test_other_files_get_whole_texts():
    import public_tokenizers

    tool = tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tool.by_word
    ids, _ = tool.encode(pa.array(TEXTS, pa.string()), 2)
    assert ids.tolist() == [i for t in TEXTS for i in whole(tool, t, 2)]


def test_memory_is_bounded(tool, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    fresh = tokens.WordTokenizer(tokenizer_path())
    for t in TEXTS * 2:
        assert fresh.encode(pa.array([t], pa.string()), 2)[0].tolist() == whole(tool, t, 2)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tool, tmp_path):
    rows = [((i * 7) % 50, TEXTS[i % len(TEXTS)]) for i in range(50)] + [(None, "null")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("clash"))
    path = f"file://{tmp_path}/t"
    tokens.write_tokens(df, path, tokenizer_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(spark, path).collect()}
    at, want = 0, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(tool, t, 2)
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want
    meta = tokens.read_tokens(spark, path, tokens=False)
    assert "tokens" not in meta.columns and meta.agg(F.sum("n_tokens")).first()[0] == at
    assert tokens.token_table(df.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_packing_of_sizes(sizes):
    bins = packing.pack_sizes(sizes, 64, 4)
    spans = defaultdict(list)
    for b in bins:
        assert 0 < sum(n for *_, n in b) <= 64 and all(n > 0 for *_, n in b)
        for d, s, n in b:
            spans[d].append((s, n))
    for d, size in enumerate(sizes):
        at = 0
        for s, n in sorted(spans[d]):
            assert s == at
            at += n
        assert at == size
    total = sum(sizes)
    assert len(bins) <= -(-total // 60) + 2  # gaps below the least cut stay


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_rests_are_first_fit_decreasing(sizes):
    bins = []
    for size, d in sorted(((n, d) for d, n in enumerate(sizes) if 0 < n < 64), key=lambda x: -x[0]):
        at = next((b for b in bins if sum(n for n, _ in b) + size <= 64), None)
        if at is None:
            bins.append(at := [])
        at.append((size, d))
    got = packing.pack_sizes(sizes, 64, least_cut=65)
    assert [[(d, 0, 64)] for d, n in enumerate(sizes) if n == 64] + [[(d, 0, n) for n, d in b] for b in bins] == got


def test_equal_rows_spread_over_groups(spark):
    rows = spark.createDataFrame([(None, "wort " * 400)] * 200, "doc_id bigint, text string").withColumn("__tie", F.lit(1)).withColumn("length", F.lit("clash"))
    got = packing.pack(rows, tokenizer_path(), group_bytes=20_000)
    assert got.agg(F.sum("length")).first()[0] == 200 * 401 and got.select(F.shiftright("sequence_id", 32)).distinct().count() > 10


def test_repeated_ids_keep_their_places(spark, tool, tmp_path):
    rows = [(i % 3, TEXTS[i % len(TEXTS)]) for i in range(30)]
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/t", tokenizer_path())
    at = 0
    for r in tokens.token_digests(spark, f"file://{tmp_path}/t").orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(whole(tool, t, 2)) for _, t in rows)


def test_files_have_the_encodings_and_pages_they_claim(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.lit("wort und satz " * 5)).alias("text")).coalesce(1)
    tokens.write_tokens(df, f"file://{tmp_path}/t", tokenizer_path(), row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = sorted(tmp_path.glob("t/*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_row_groups for m in meta) > 1
    columns = {c.path_in_schema: c for c in (meta[0].row_group(0).column(i) for i in range(meta[0].num_columns))}
    ids = next(c for p, c in columns.items() if p.startswith("tokens"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for p, c in columns.items() if not p.startswith("tokens")) and ids.has_offset_index
    plan = tokens.read_tokens(spark, f"file://{tmp_path}/t", tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:" not in plan.split("ReadSchema:")[1].replace("n_tokens:", "")
    few = tokens.read_tokens(spark, f"file://{tmp_path}/t").where("doc_id between 700 and 702")
    assert "GreaterThanOrEqual(doc_id,700)" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 3


def test_first_fit_takes_the_first_bin():
    tree = packing.FirstFit(4, 10)
    assert [tree.put(n) for n in (6, 5, 4, 5, 3)] == [0, 1, 0, 1, 2]


def test_packing(spark, tool):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(0, TEXTS[0]), (None, "x y")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path(), group_bytes=40_000).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for d, t in rows:
        ids = whole(tool, t, 1)
        pieces = sorted(docs[d], key=lambda p: p[0])
        joined = [i for _, p, _ in pieces for i in p]
        assert (joined == ids) if d != 0 else sorted(joined) == sorted(ids * 2)
        assert all(n == len(ids) for *_, n in pieces)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "lang " * 200_000
    rows = [(1, "http://a/1", "gleich"), (5, None, "gleich"), (3, "http://a/\r\n3", "gleich"), (2, "u", None), (4, "u", ""), (6, "ü", big), (None, "n", "gleich"), (7, "x", "HTTP\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder, roll_bytes=500)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    for i, url, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data)) and (url is None) == (r.url is None)
        keeper = {"gleich": 5, "": 4}.get(html or "")
        again = keeper not in (None, i) and i is not None
        assert (r.record_type, r.refers_to) == (("revisit", keeper) if again else ("response", None))
        assert r.payload == (b"" if again else data)
    fields = [f for p in (tmp_path / "w/archives").glob("*.gz") for f, _ in warc.read_records(p.open("rb"))]
    named = {f["warc-record-id"]: f for f in fields}
    for f in (x for x in fields if x["warc-type"] == "revisit"):  # names the response by record, address and date
        to = named[f["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["warc-payload-digest"] == f["warc-payload-digest"]
        assert f["warc-refers-to-date"] == to["warc-date"] and f.get("warc-refers-to-target-uri") == to.get("warc-target-uri")
    least = warc.write_archives(pages, f"file://{tmp_path}/v", least_bytes=5)
    assert {r.page_id for r in warc.read_archives(least, payload=False).where("record_type = 'revisit'").collect()} == {1, 3}
    assert warc.archive_table(pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    one, two = (warc.record("response", i, "u", b"inhalt " * i, warc.digest(b"inhalt " * i)) for i in (1, 20_000))
    assert [len(p) for _, p in warc.read_records(io.BytesIO(one + two))] == [7, 140_000]
    raw = zlib.decompress(one, 31)
    for bad in (raw.replace(b"inhalt", b"INHALT"), raw.replace(b"WARC/1.1", b"WARC/9.9"), raw[:-1], raw + b"x", raw.replace(b"Content-Length: 7", b"Content-Length: x", 1), raw.replace(b"\r\nContent-Length", b"\r\nContent-Len")):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(pack.compress(bad) + pack.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(two[:-20])))
