"""The pipeline's stages on a small table, and the queries against their SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as p
from ratlas.llm.queries import oracle_sql, queries

DATA = os.environ.get("RATLAS_DATA", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    shared = "Diese Zeile steht in vielen Texten und ist lang genug dafür"
    rows = [(i, f"{text(80)}\n{shared}\n{text(80)}", "de", f"s{i % 4}", 5) for i in range(40)]
    rows += [(40 + i, rows[i][1] + " ende", "de", "s1", 5) for i in range(10)] + [(60, "kurz", "de", "s2", 4), (61, None, None, None, None), (62, "a b c " * 90, "de", "s3", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    seen = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack_sequences":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs)
    good, lined, near, mixed, packed = seen
    assert sorted(r.doc_id for r in good.collect()) == list(range(50))
    assert [r.doc_id for r in lined.collect() if shared in r.text] == [49] and all(r.n_chars == len(r.text) or r.doc_id == 49 for r in lined.collect())
    assert sorted(r.doc_id for r in near.collect()) == list(range(40))
    assert {r.doc_id for r in mixed.collect()} <= set(range(40)) and mixed.count() >= 40
    assert packed.count() > 0
    assert p.run(spark, f"file://{tmp_path}").count() == packed.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    result = con.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    assert Counter(map(tuple, got)) == Counter(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, `a.b` string"


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "pack_sequences" or out.columns == docs.columns)


def test_stages_on_repeated_and_broken_rows(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    long = [text(120) for _ in range(8)]
    rows = [(i, t, "de", None if i == 3 else f"s{i % 2}", len(t), "k", i, "x") for i, t in enumerate(long)]
    rows += [rows[0], rows[0], (20, long[0], "de", "s0", 1, "k", 1, None), (None, text(90), None, None, None, None, None, None), (None, None, "de", "s1", None, "k", 0, ""), (21, "", "de", "s1", 0, "k", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, "")
        if name != "pack_sequences":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs)
    good, lined, near, mixed, packed = seen
    assert Counter(r.doc_id for r in good.collect()) == Counter([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 20, None]) == Counter(r.doc_id for r in lined.collect())
    assert Counter(r.doc_id for r in near.collect()) == Counter([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, None])
    assert {r["a.b"] for r in near.collect()} == {"x", None} and {r.key for r in mixed.collect()} <= {"k", None}
    assert packed.count() >= mixed.count() > 0
