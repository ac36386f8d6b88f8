"""Stored indexes give the rows of scans, and read less; commits are whole or not there."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratlas.operators import index, postings, sessions, trigrams, vector_index, vectors
from ratlas.operators.bitmaps import Coverage
from ratlas.operators.vector_cells import NO_CELL, Cells
from ratlas.sources import named_files, sqlite, table_functions
from ratlas.sources.keyed import Conflict, KeyedTable
from ratlas.streaming import landing


def plan(df):
    return df._jdf.queryExecution().toString().partition("Physical Plan")[2]


def rows(df):
    return [tuple(r) for r in df.collect()]


def near(a, b):
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-12)


def test_postings_equal_the_scan(spark, tmp_path):
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(4000)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(1500)] + [(2000, None), (2001, ""), (None, "w1 w2"), (2002, "w1 w1 W1 w2"), (2003, "w1 w1 W1 w2")]
    docs = spark.createDataFrame(texts, "id bigint, text string").withColumn("term", F.lit("x")).repartition(4)
    path = f"file://{tmp_path}/p"
    postings.build(docs.where("id < 900"), path, buckets=8, block=16)
    postings.build(docs.where("id >= 900"), path, buckets=8, block=16, mode="append")  # blocks of further documents
    known = docs.where("id IS NOT NULL")
    for terms in (["w1"], ["w1", "w2", "w3"], ["w399", "w1"], ["w17", "w1", "w1", "none"], ["none"]):
        for k in (1, 10, 5000):
            near(rows(postings.search(spark, path, terms, k, buckets=8)), rows(vectors.top(vectors.term_scores(known, terms), k)))
    among = spark.range(0, 1500, 7).toDF("id")
    near(rows(postings.search(spark, path, ["w1", "w2"], 10, among, buckets=8)), rows(vectors.top(vectors.term_scores(known.join(among, "id", "left_semi"), ["w1", "w2"]), 10)))
    assert postings.search(spark, path, [], 3, buckets=8).count() == 0
    for terms in ({"w1": 1.0}, {"w1": 1.0, "w90": 0.1}):
        s = postings.stats(spark, path, terms, 5, buckets=8).first()
        assert 0 < s.blocks_read < s.blocks and s.postings_read < s.postings
    blocks, _ = postings.of_terms(spark, path, ["w1"], buckets=8)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(blocks))
    assert len({Path(f).parent.name for f in blocks.inputFiles()}) == 8 and len({r.f.split("/")[-2] for r in blocks.select(F.input_file_name().alias("f")).distinct().collect()}) == 1
    with pytest.raises(ValueError):
        postings.search(spark, path, {"w1": -1.0}, 3, buckets=8)


def test_a_term_of_all_texts_spreads(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    postings.build(spark.range(4000).select("id", F.lit("rat und tat").alias("text")).repartition(4), path, block=32)
    got = spark.read.parquet(path).agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    assert (got.n, got.all) == (32, 12_000)
    assert [r.id for r in postings.search(spark, path, ["rat"], 3).collect()] == [0, 1, 2]


def test_cells_equal_the_scan(spark, tmp_path):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(12, 16)) * 3
    data = [(i, (centers[i % 12] + rnd.normal(size=16)).tolist(), i % 5) for i in range(1200)]
    data += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [1.0], 1), (5004, [float("inf")] * 16, 1), (5005, data[0][1], 0), (5006, [x * 1e200 for x in data[0][1]], 0)]
    v = spark.createDataFrame(data, "id bigint, dense array<double>, label int").withColumn("far_", F.lit(1)).repartition(3)
    index_ = Cells(spark, f"file://{tmp_path}/c")
    index_.build(v, cells=12, sample=300)
    assert index_.rows().count() == len(data) and index_.rows().where(F.col("cell") == NO_CELL).count() == 5
    for q in (data[7][1], (-np.array(data[7][1])).tolist(), rnd.normal(size=16).tolist()):
        for k in (1, 20, 5000):
            near(rows(index_.search(q, k)), rows(vectors.top(vectors.cosine(v, q), k)))
        near(rows(index_.search(q, 9, F.col("label") == 3)), rows(vectors.top(vectors.cosine(v.where("label = 3"), q), 9)))
    s = index_.stats(data[7][1], 5).first()
    assert s.cells_read < s.cells and s.vectors_compared < s.vectors
    reach, read = index_.reach(data[7][1], 5)
    assert {r.cell for r in reach.select("cell").distinct().collect()} <= set(read) and "PartitionFilters: [cell" in plan(reach)
    for q in ([0.0] * 16, [float("nan")] * 16, [1.0]):
        assert index_.search(q, 3).count() == 0
    empty = Cells(spark, f"file://{tmp_path}/e")
    empty.build(v.limit(0))
    assert empty.search(data[0][1], 3).count() == 0


def test_trigrams_equal_the_scan(spark, tmp_path):
    rnd = random.Random(4)
    bits = ["Rat", "haus", "ÖPNV", "Ärger", "%", "_", "wind", "a", "", "Straße 12"]
    say = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 5))) or None
    docs = spark.createDataFrame([(i, str(i % 40), *[say() for _ in range(6)]) for i in range(600)] + [(7, "99", "Rathaus", *[None] * 5)], "id bigint, session_id string, title string, document_type string, category string, agenda_item string, local_path string, content_type string").repartition(3)
    own = spark.createDataFrame([(str(i), f"2025-0{1 + i % 9}-01", rnd.choice(bits) * 2, say()) for i in range(40)], "session_id string, date string, committee string, meeting_name string")
    path = f"file://{tmp_path}/t"
    trigrams.index_documents(docs, own, path)
    for q in ("rathaus", "HAUS öpnv", "ärger wind", "%_", "a", "ra", "2025-03 rat", "gibtsnicht", "", "straße 12", "windwind"):
        got = trigrams.search(docs, own, q, path)
        assert rows(got) == rows(sessions.search(docs, own, q)), q
    assert trigrams.candidates(spark, path, [""]) is None
    assert 0 < trigrams.candidates(spark, path, ["windwind"]).count() < 300
    trigrams.build(own, ("meeting_name", "committee"), f"{path}s", "session_id", block=8)
    for q in ("rat", "haus%wind", "wi_d", "", "%", "straße"):
        f = sessions.Filters(search=q)
        assert sorted(map(str, rows(trigrams.filtered(own, f, "2025-05-01", f"{path}s")))) == sorted(map(str, rows(sessions.filtered(own, f, "2025-05-01")))), q


def test_not_in_without_broadcast(spark):
    s = spark.createDataFrame([("1",), ("2",), (None,)], "session_id string")
    d = lambda *x: spark.createDataFrame([(v,) for v in x], "session_id string")
    sql = lambda x: sorted(map(str, rows(spark.sql("SELECT session_id FROM {s} WHERE session_id NOT IN (SELECT session_id FROM {d})", s=s, d=x))))
    for x in (d("1"), d("1", None), d(), d(None), d("1", "1", "3")):
        assert sorted(map(str, rows(index.incomplete(s, x)))) == sql(x)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(index.incomplete(s, d("1", None))) and "Broadcast" not in plan(index.to_refresh(s, s.limit(1), d("1")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_each_new_document_is_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(3, "zwei"), (4, "a")], "id bigint, text string")
    old = spark.createDataFrame([(i, [1.0]) for i in range(3)] + [(77, [2.0])], "id bigint, dense array<double>")

    def model(batches):
        import pyarrow as pa

        for b in batches:
            calls.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(len(t))] for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["id", "dense"])

    df = vector_index.build(docs, old, lambda x: x.mapInArrow(model, "id bigint, dense array<double>"))
    assert plan(df).count("MapInArrow") == 1
    got = dict(rows(df))
    assert calls.value == 17
    assert sorted(got) == list(range(20)) and got[3] == [4.0] and got[4] == [2.0] and got[0] == [1.0]


def test_keyed_table_against_a_dictionary(spark, tmp_path):
    rnd, table = random.Random(5), KeyedTable(spark, f"file://{tmp_path}/k", "k string, v int, w string", "k")
    want: dict = {}
    assert rows(table.read()) == []
    for batch in range(9):
        size = 40 if batch == 0 else 5
        new = [(rnd.choice([None, *[f"k{i:02d}" for i in range(60)]]), rnd.randrange(100), "x") for _ in range(size)]
        gone = [f"k{rnd.randrange(60):02d}" for _ in range(3)] if batch % 2 else []
        df = spark.createDataFrame(new, table.schema)
        table.apply(df, spark.createDataFrame([(g,) for g in gone], "k string"), writer="w", batch=batch, ranges=4, most_deltas=2)
        table.apply(df.limit(0), writer="w", batch=batch)  # again: counts once
        for k in {*gone, *(r[0] for r in new)}:
            want.pop(k, None)
        for r in new:
            want.setdefault(r[0], []).append(r)
        assert sorted(map(str, rows(table.read()))) == sorted(str(r) for x in want.values() for r in x), batch
    assert all(len(f["deltas"]) <= 2 for f in table.current()["ranges"].values())
    before = rows(table.read())
    assert table.vacuum() and sorted(map(str, rows(table.read()))) == sorted(map(str, before))


def files(folder: Path):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/k", "k bigint, v string", "k")
    table.upsert(spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), ranges=8, writer="s", batch=0)
    old = files(tmp_path)
    whole = sum(p.stat().st_size for p in old)
    for n in range(1, 6):
        table.upsert(spark.createDataFrame([(17, f"neu{n}"), (18, f"neu{n}")], table.schema), writer="s", batch=n, most_deltas=3)
    new = {p for p in files(tmp_path) if p not in old}
    assert all(old[p] == t for p, t in files(tmp_path).items() if p in old)  # nothing is changed in place
    assert sum(p.stat().st_size for p in new) < whole / 2  # five deltas and one range compacted once
    m = table.current()
    assert len(m["ranges"]) == 8 and sum(bool(f["deltas"]) for f in m["ranges"].values()) <= 1
    got = table.read()
    assert got.count() == 20_000 and got.where("k = 17").first().v == "neu5" and got.where("k = 19").count() == 1
    assert plan(got).count("Exchange") <= 4


def test_a_crash_before_the_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/k", "k bigint, v string", "k")
    row = lambda k, v: spark.createDataFrame([(k, v)], table.schema)
    table.upsert(row(1, "a"), writer="s", batch=0)

    def dies(*_):
        raise OSError("machine lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(OSError):
            table.upsert(row(1, "b"), writer="s", batch=1)
    assert rows(table.read()) == [(1, "a")]
    (tmp_path / "k/versions/000000000002.json").write_text('{"version": 2, "bou')  # a writer that died in its manifest
    assert rows(table.read()) == [(1, "a")]
    table.upsert(row(1, "b"), writer="s", batch=1)
    assert rows(table.read()) == [(1, "b")] and table.current()["version"] == 3
    assert len(table.vacuum()) == 1
    base = table.current()
    table.upsert(row(2, "c"))
    with pytest.raises(Conflict):
        table._commit(base, base)
    assert sorted(rows(table.read())) == [(1, "b"), (2, "c")] and rows(table.read(3)) == [(1, "b")]


def test_stream_follows_the_batch(spark, tmp_path):
    schema = "id string, v string, at string"
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, "id")
    put = landing.upsert_batch(table, "at")
    for n in (0, 1, 1, 2, 3, 3):  # batches that run again count once
        put(spark.createDataFrame([(str(n % 2), f"v{n}", str(n)), (str(n % 2), "alt", "")], schema), n)
    assert sorted(rows(table.read().select("id", "v"))) == [("0", "v2"), ("1", "v3")]


def test_sparse_vectors_give_the_scores_of_texts(spark):
    docs = spark.createDataFrame([(1, "Rat der rat stadt"), (2, None), (3, "; - a"), (4, "stadt " * 300)], "id bigint, text string")
    got = {r.id: dict(zip(r.sparse.indices, r.sparse["values"], strict=True)) for r in vectors.sparse_vectors(docs).collect()}
    assert sorted(got) == [1, 4]
    for term in ("rat", "stadt", "der"):
        h = spark.range(1).select(F.xxhash64(F.lit(term))).first()[0]
        assert {r.id: r.score for r in vectors.term_scores(docs, [term]).collect()} == {i: x[h] for i, x in got.items() if h in x}


def test_sqlite_store(spark, tmp_path):
    schema = "k bigint, t string, d double, b boolean, x binary, i int"
    rows_ = [(i, None if i % 7 == 0 else f"t{i % 5}ä%_", i / 4, i % 2 == 0, bytes([i % 256]), i) for i in range(500)] + [(None,) * 6]
    df = spark.createDataFrame(rows_, schema).repartition(3)
    path = f"file://{tmp_path}/store"
    sqlite.write(df, path, "r")
    got = sqlite.read(spark, path, "r", schema, rows=40)
    key = lambda x: sorted(map(str, x))
    assert key(rows(got)) == key(rows_) and len(list((tmp_path / "store").glob("*.sqlite"))) == 3
    for where in ("k = 7", "k > 10 AND k <= 20", "t = 't1ä%_'", "t LIKE 't1%'", "t LIKE '%_' AND k < 9", "t IS NULL", "t IS NOT NULL AND b", "NOT b", "d >= 100.5", "k IN (1, 2, 999)", "k <=> NULL", "t <> 't2ä%_'", "NOT (t LIKE 't1%')", "contains(t, 'ä')", "endswith(t, '%_')", "i BETWEEN 3 AND 5 OR k = 8", "x = X'05'", "k % 50 = 3"):
        assert key(rows(got.where(where))) == key(rows(df.where(where))), where
    scan = plan(got.where("k = 7 AND t LIKE 't%'").select("t"))
    assert "BatchScan ratlas_sqlite" in scan and "Filter (" not in scan  # all conditions run inside the files
    assert "Filter (" in plan(got.where("k % 50 = 3"))
    wider = sqlite.read(spark, path, "r", "k bigint, new string, t int")
    assert wider.where("new IS NULL AND t IS NULL").count() == 501  # a column that is missing, and texts read as numbers
    assert sqlite.read(spark, path, "none", schema).count() == sqlite.read(spark, f"{path}/none", "r", schema).count() == 0
    (tmp_path / "store/broken.sqlite").write_bytes(b"no database" * 100)
    assert sqlite.read(spark, path, "r", schema).count() == 501
    with pytest.raises(Exception, match="FileExistsError"):
        sqlite.write(df, path, "r")
    sqlite.write(df.where("k < 3"), path, "r", "overwrite")
    assert key(rows(sqlite.read(spark, path, "r", schema))) == key(rows_[:3]) and sorted(p.name for p in tmp_path.iterdir()) == ["store"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def dies(k):
        if k == 57:
            raise ValueError("broken row")
        return str(k)

    df = spark.range(100).repartition(4).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), dies("id").alias("content"))
    for put in (lambda: named_files.write(df, f"file://{tmp_path}/f"), lambda: sqlite.write(df, f"file://{tmp_path}/s", "r")):
        with pytest.raises(Exception, match="broken row"):
            put()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_named_files_never_replace(spark, tmp_path):
    put = lambda *x: named_files.write(spark.createDataFrame(list(x), "name string, content binary"), f"file://{tmp_path}")
    put(("a/b.tar.gz", b"1"), ("c", b"2"), (".x", None), ("a.b/c", b"3"))
    put(("a/b.tar.gz", b"4"), ("c", b"5"), ("a.b/c", b"6"))
    put(("c", b"7"))
    got = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert got == {"a/b.tar.gz": b"1", "a/b.tar.1.gz": b"4", "c": b"2", "c.1": b"5", "c.2": b"7", ".x": b"", "a.b/c": b"3", "a.b/c.1": b"6"}
    for bad in ("../x", "/x", "", None, "a//b"):
        with pytest.raises(Exception, match="no name below the folder"):
            put((bad, b""))
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 8 and not list(tmp_path.glob("_staging*"))


def test_table_functions(spark):
    table_functions.register(spark)
    page = "<table class='Tagesordnung'><tr><td>1</td><td>Haushalt</td><td>vertagt</td><td><a href='getfile.asp?id=4'>Vorlage</a></td></tr><tr><td>2</td><td>Ende</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>leer")], "page_id int, html string")
    got = spark.sql("SELECT p.page_id, a.number, a.text, a.status, a.documents, a.first_href FROM {p} p, LATERAL agenda_rows(p.html) a", p=pages)
    assert sorted(rows(got)) == [(1, "1", "Haushalt", "vertagt", 1, "getfile.asp?id=4"), (1, "2", "Ende", None, 0, None)]
    assert rows(spark.sql("SELECT d.href, d.title FROM {p} p, LATERAL document_links(p.html) d", p=pages)) == [("getfile.asp?id=4", "Vorlage")]
    with pytest.raises(Exception, match="argument 1 must be string"):
        spark.sql("SELECT * FROM agenda_rows(1)").collect()


def test_coverage_by_bitmaps(spark, tmp_path):
    rnd, status = random.Random(6), Coverage(spark, f"file://{tmp_path}/b")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id bigint")
    assert status.coverage().first().status == "missing_index"
    current, indexed = [], []
    for batch in range(3):
        new = [rnd.choice((rnd.randrange(-40_000, 120_000), rnd.randrange(2**62))) for _ in range(200)]
        current += new
        indexed += [*rnd.sample(new, 120), rnd.randrange(10**6)]
        for side, x in (("current", [*new, None, new[0]]), ("indexed", indexed[-121:])):
            for _ in range(2):  # a batch that comes again counts once
                status.add(side, ids(x), "id", batch)
        assert tuple(status.coverage().first()) == tuple(index.coverage(ids(current), ids(indexed), "id").first())
    read = {f for f in status.bits().inputFiles()}
    assert all("/side=" in f for f in read) and len({f.rsplit("/", 1)[0] for f in read}) == 6
    status.replace("indexed", ids(current), "id", 3)
    assert status.coverage().first().status == "ok" and status.coverage().first().coverage_percent == 100.0
    with pytest.raises(ValueError):
        status.add("other", ids(current), "id", 0)
