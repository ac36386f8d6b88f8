"""Near duplicates and language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratlas.llm import blocks, embeddings, graph, minhash, ppm


def closure(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(400, 600), rnd.randrange(400, 600)) for _ in range(120)] + [(0, i) for i in range(1, 90)] + [(7, 7)]
    edges = spark.createDataFrame(pairs + pairs[:9], "a bigint, b bigint")
    got = {r.id: r.component for r in graph.connected_components(edges).collect()}
    want = closure({i for p in pairs for i in p}, pairs)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert graph.connected_components(edges.limit(0)).count() == 0


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def check_texts(spark, rows, n=4):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_texts(df, n, 80).collect()}
    sets = {i: shingles(t, n) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, pairs)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    return pairs


def test_near_texts(spark):
    rnd = random.Random(3)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows, base, passage = [(0, None), (1, ""), (2, " \n"), (3, "Nur drei Worte"), (4, "nur DREI worte"), (5, "nur drei")], text(300), text(60)
    for i in range(6, 66):  # a cloud around one text, links between many but not all
        t = list(base)
        for _ in range(i % 15):
            t[rnd.randrange(300)] = "neu" + str(rnd.random())
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(base) + "\n") for i in range(66, 90)]
    rows += [(i, " ".join(text(80) + passage + text(80))) for i in range(90, 130)]
    rows += [(i, " ".join(text(40))) for i in range(130, 150)]
    rows.append((150, " ".join(f"w{i}" for i in range(30_000))))
    rows.append((151, " ".join(f"w{i}" for i in range(29_000))))
    assert len(check_texts(spark, rows)) > 1000


def test_near_texts_edges(spark):
    check_texts(spark, [(1, "a b c d e"), (2, "a b c d e f"), (3, "x"), (4, "x"), (5, "X ")])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_texts(empty).count() == 0 and minhash.drop_near_texts(empty).count() == 0
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_texts(twins).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in minhash.drop_near_texts(twins).collect()) == [0, 1, 1]


def test_early_bounds_lose_nothing():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 2**64, 4000, np.uint64))
    sets = [pool[:0], pool[:1]]
    for _ in range(120):
        base = rng.choice(pool, rng.integers(1, 400), replace=False)
        for keep in (1.0, 0.95, 0.9, 0.85, 0.5):
            mine = rng.choice(base, max(1, int(len(base) * keep)), replace=False)
            sets.append(np.unique(np.concatenate([mine, rng.choice(pool, rng.integers(0, 30))])))
    import pyarrow as pa

    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
    found, want, held = minhash.Sets(lists, 80), 0, [set(x.tolist()) for x in sets]
    for i in range(len(sets)):
        rest = np.arange(i + 1, len(sets))
        exact = [j for j in rest if len(held[i] & held[j]) * 100 >= 80 * len(held[i] | held[j]) and held[i]]
        assert found.similar(found.of(i), rest).tolist() == exact
        want += len(exact)
    assert want > 100


def test_star_members_are_dealt(spark):
    sets = spark.createDataFrame([(i, list(range(100 + i % 60))) for i in range(300)], "id bigint, shingles array<bigint>")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(5, 7), (7, 5)], "a bigint, b bigint")
    got = {(r.a, r.b) for r in minhash._linked(pairs, sets, 80, chunk=16).collect()}
    assert got == {(0, i) for i in range(1, 300) if 100 * 100 >= 80 * (100 + i % 60)} | {(5, 7), (7, 5)}


def test_vectors_of_one_bucket_but_other_kinds_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(embeddings.F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes collide
    rows = [(i, [1.0, 0.001 * i] if i % 3 else [1.0, 0.001 * i, 0.0], i % 2) for i in range(24)] + [(0, [1.0, 0.0], 1)]
    got = {(r.vec_id, r.n_links) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 0.93).collect()}
    kinds = Counter((x[2], len(x[1])) for x in rows)
    assert got == {(i, kinds[(label, len(v))] - 1) for i, v, label in rows}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, np.uint64)])
    s = minhash.signatures(np.concatenate([a, b]), np.array([1000, 0, 1000]), 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.07


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 16)
    rng = np.random.default_rng(5)
    v = [rng.standard_normal(16) for _ in range(60)]
    v += [v[0] + rng.standard_normal(16) * 0.12 for _ in range(70)] + [v[1] * (1 + i) for i in range(5)] + [v[2]] * 40
    rows = [(i, x.astype("f4").tolist(), int(i % 11 == 0)) for i, x in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, rows[2][1], None), (905, rows[2][1][:8], 0), (906, [], 0), (907, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_vectors(df, 0.93).collect()}
    unit = {i: np.array(x, "f8") / np.linalg.norm(np.array(x, "f8")) for i, x, _ in rows[:175]}
    pairs = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    links, want = Counter(i for p in pairs for i in p), closure([r[0] for r in rows], pairs)
    assert {i: got[i].component_id for i in got} == want and all(got[i].kept == (want[i] == i) for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(pairs) and all(got[i].n_links <= links[i] for i in got)
    assert all(got[i].n_links == 0 for i in range(900, 908)) and len(got) == len(rows)
    assert embeddings.near_vectors(df.limit(0), 0.93).count() == 0


def test_block_pairs_meet_once(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 2 as bigint) as bucket")
    rows = blocks.blocks(df, "bucket", "id", df.select("id"), 8).collect()
    seen = Counter()
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.side_a, r.side_b), []).append(r)
    for (_, a, b), g in groups.items():
        for i, x in enumerate(g):
            for y in g[i + 1 :]:
                if a == b or x.side != y.side:
                    seen[frozenset((x.id, y.id))] += 1
    assert len(seen) == 2 * 25 * 24 // 2 and set(seen.values()) == {1}


def test_near_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 1.0], 2), (4, [0.0, 1.0], 2)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), cosine=0.93)
    out = got.collect()
    assert len(out) == len(rows) and {r.component_id for r in out if r.vec_id == 2} == {1} and all(r.kept == (r.vec_id == r.component_id) for r in out)
