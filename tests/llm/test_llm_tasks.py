"""Importance resampling, tokenizer alignment and license scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratlas.llm import crosstok, licenses, resample

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [None, "", " ", "\n", "  a", "a  ", "a ", " a b ", "Ärger ÄRGER É", "x" * 4000, "\x00a\x00b\x1cc", "a  b  c  d", "tab\tbed \r\n \n zeile", "<|endoftext|> <s> </s>", "▁mark hier", "😀 é 가나 \x85 z", "don't we're I'll"]


def frame(spark, texts, parts=3):
    """Each text in a row, some rows twice, with columns of clashing names."""
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"row": F.lit("x"), "chunk": F.lit(1), "at": F.lit(2), "label": F.lit("y")}).repartition(parts), rows


def some_texts(seed, n, words):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(n)]


def features(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_ring_over_blocks():
    rnd = random.Random(2)
    for text in [*EDGES[1:], " ".join(rnd.choice(("ab", "Ö", "c1-", "d")) for _ in range(300))]:
        for size in (1, 3, 7, 1 << 18):
            words, found = 0, []
            for n, x in resample.ring(text.encode(), 3, size):
                words, found = words + n, found + (x % 10_000).tolist()
            assert (words, Counter(found)) == (lambda n, f: (n, Counter(f)))(*features(text))


def test_resample(spark):
    texts = EDGES + some_texts(4, 150, ["Alpha", "beta", "gam-ma", "ö", "x1", "the", "of"])
    df, rows = frame(spark, texts)
    target = spark.createDataFrame([("alpha beta the of the",), (None,), ("beta the",)], "text string")
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in ("alpha beta the of the", "beta the"):
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        want.append((n >= 20, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(f), w))
    able = sorted((x for x in want if x[0]), key=lambda x: (-x[1], x[2]))
    drawn = {x[2]: k for k, x in enumerate(able[: 5 * len(able) // 100], 1)}
    got = resample.resample(df, target).collect()
    assert Counter(map(tuple, got)) == Counter((i, n, w, sc, drawn.get(i)) for _, sc, i, n, w in want)
    assert len(drawn) >= 5
    assert resample.resample(df.limit(0), target).count() == 0
    assert resample.resample(df, target.limit(0)).count() == len(rows)


def brute_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pair = crosstok.Pair.of(A, B)
    docs, counts = [], Counter()
    for i, t in rows:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(pair.bytes_a[x] for x in ia) != want or b"".join(pair.bytes_b[x] for x in ib) != want:
            docs.append((i, [], [], []))
            continue
        ends = lambda ids, size: [sum(size[x] for x in ids[: k + 1]) for k in range(len(ids))]
        ea, eb = ends(ia, pair.size_a), ends(ib, pair.size_b)
        links = [(x, y) for x, e in zip(ia, ea, strict=True) for y, f in zip(ib, eb, strict=True) if e == f]
        counts.update(links)
        both, p, q, groups = sorted(set(ea) & set(eb)), 0, 0, []
        for e in both:
            m, n = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, ia[p:m])) + "|" + ",".join(map(str, ib[q:n])))
            p, q = m, n
        docs.append((i, ia, ib, links, groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (x[0], len(x[1]), len(x[2]), len(x[4]), len(x[3]), sum(counts[k] == top[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(";".join(x[4]).encode()).hexdigest()) if x[1] else (x[0], 0, 0, 0, 0, 0, 0, "")
        for x in docs
    ]


def test_alignment(spark):
    words = ["alpha", "Straße,", "don't", "\n", "  ", "x\n", " ", "the", "of", "1234567", "日本語テキスト", "()[]", "\tq", "thhaerly."]
    texts = EDGES + some_texts(5, 60, words)
    df, rows = frame(spark, texts)
    want = Counter(brute_alignment(rows))
    for chunk, most in ((1 << 24, 1 << 21), (2000, 0)):  # one chunk a task, many small ones with joined counts
        assert Counter(map(tuple, crosstok.align_corpus(df, A, B, chunk, most).collect())) == want
    assert crosstok.align_corpus(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        crosstok.Pair(public_tokenizers.path("word_bpe_49k.json"), B).verify()


def test_segments_give_the_text():
    rnd = random.Random(8)
    for _ in range(2000):
        t = "".join(rnd.choice(" \n ab") for _ in range(rnd.randrange(1, 12)))
        assert "".join(" " + s for s in crosstok.segments_of(t)) == " " + t
        cuts = len([k for k in range(1, len(t)) if t[k] == " " and not t[k - 1].isspace() and k + 1 < len(t)])
        assert len(crosstok.segments_of(t)) == cuts + 1


def brute_licenses(text, k=licenses.RUN, gap=licenses.GAP):
    w = [x for x in re.split(licenses.BREAK, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, cover = set(), 0.0
    for label, t in licenses.TEMPLATES:
        t, diagonals = t.split(), {}
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    d = diagonals.setdefault(i - j, (set(), []))
                    d[0].update(range(j, j + k))
                    d[1].append(i)
        spans = []
        for d in sorted(diagonals):
            if spans and d - spans[-1][-1] <= gap:
                spans[-1].append(d)
            else:
                spans.append([d])
        for s in spans:
            held = set().union(*(diagonals[d][0] for d in s))
            wide = max(max(diagonals[d][1]) for d in s) + k - 1 - min(min(diagonals[d][1]) for d in s)
            best = max(len(diagonals[d][0]) for d in s) / len(t)
            cover = max(cover, len(held) / len(t))
            if best >= licenses.COVER or (len(held) / len(t) >= licenses.COVER and wide < 2 * len(t)):
                more.add(label)
    own = {x for _, x in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if at else cover


def test_licenses(spark):
    rnd = random.Random(9)
    texts = list(EDGES)
    for _, t in licenses.TEMPLATES:
        w = t.split()
        for cut in (0, 1, 3):  # whole; with words put in, left out, changed
            v = list(w)
            for _ in range(cut):
                i = rnd.randrange(len(v))
                v[i : i + rnd.randrange(2)] = rnd.choice(([], ["zzz"], ["yy", "xx"]))
            texts += [f"Vorher, {' '.join(v).title()}.\nnachher " + "w " * rnd.randrange(9), " - ".join(v + v), " ".join(v[: len(v) // 2])]
    texts += ["CC-BY, cc by; Apache\nLicense mit LICENSE GNU general  public license cc", "limit license", "the mit licenses cc byte", "released under the mit license " * 30]
    df, rows = frame(spark, texts)
    got = licenses.scan(df).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_licenses(t)) for i, t in rows)
    labels = {x for r in got for x in r.labels.split(",")}
    assert {label for label, _ in licenses.TEMPLATES} <= labels
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.partition("Physical Plan")[2])
