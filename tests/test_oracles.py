"""Every core query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from ratlas.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("RATLAS_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in result.fetchall()]
    assert Counter(map(tuple, got)) == Counter(want)
