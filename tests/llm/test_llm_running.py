"""Contexts that run across words, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ratlas.llm import ppm


def stream(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return words, b"\x01" + "".join(w + " " for w in words).encode() + b"\n"


def brute_scores(train, texts):
    """log10 probability of each stream by method C with exclusion, walking a plain dictionary."""
    counts, out = {}, []
    for s in train:
        for i in range(1, len(s)):
            for k in range(min(i, ppm.ORDER) + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    for s in texts:
        total = 0.0
        for i in range(1, len(s)):
            gone = set()
            for k in range(min(i, ppm.ORDER), -1, -1):
                node = counts.get(s[i - k : i])
                if not node:
                    continue
                left = {x: c for x, c in node.items() if x not in gone}
                n, d = sum(left.values()), len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / (n + d))
                    break
                total += math.log10(d / (n + d)) if d else 0
                gone |= set(node)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("chunk_bytes", [1, ppm.CHUNK_BYTES])
def test_contexts_run_across_words(spark, chunk_bytes):
    rnd = random.Random(4)
    syllables = ["ba", "ko", "lü", "tre", "n", "é", "Zu", ".", "mi", "ro", "sch", "x"]
    rows = [(i, " ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "nie\tgesehen  xyz\n"), (204, "a b c d e"), (205, "e d c b a"), (206, "a b c d e")]
    got = {r.doc_id: r for r in ppm.score_running(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk_bytes=chunk_bytes).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    streams = {i: stream(t) for i, t in rows}
    plain = Counter(w for i in streams if not held[i] for w in [*streams[i][0], "\n"])
    n, v = sum(plain.values()), len(plain)
    want = brute_scores([s for i, (_, s) in streams.items() if not held[i]], [s for _, s in streams.values()])
    assert len(got) == len(rows)
    for (i, (words, _)), score in zip(streams.items(), want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words) + 1, sum(plain[w] > 0 for w in [*words, "\n"]), n)
        assert r.base_score == pytest.approx(sum(math.log10((plain[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, "\n"]))
        assert r.score == pytest.approx(score)
    assert got[204].score == got[206].score != pytest.approx(got[205].score)


@pytest.mark.parametrize("window", [1, 3, 7, 50])
def test_windows_change_nothing(monkeypatch, window):
    texts = pa.array(["ab cd Ef", "", None, "x", "a lange r text über alles", "ab"])
    want = list(ppm.Stream(texts).windows())[0]
    monkeypatch.setattr(ppm, "WINDOW_BYTES", window)
    got = list(ppm.Stream(texts).windows())
    assert len(got) > 1
    for k in (0, 1):
        assert np.concatenate([g[k] for g in got]).tolist() == want[k].tolist()
    assert len(want[0]) == sum(len(stream(t)[1]) - 1 for t in texts.to_pylist())


def test_running_without_training(spark):
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(only_held, "ab")], "doc_id bigint, text string")
    r = ppm.score_running(df).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0) and r.score == pytest.approx(-4 * math.log10(256))
    assert ppm.score_running(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert ppm.score_running(nulls).count() == 4


def test_no_language_shares_anothers_words(spark):
    texts = [(10 * k + j, f"wort{j} und satz {k}") for k in range(12) for j in range(3)]
    score = lambda lang: {r.doc_id: r.score for r in ppm.score_running(spark.createDataFrame([(i, t, lang(i)) for i, t in texts], "doc_id bigint, text string, lang string")).collect()}
    assert score(lambda i: f"l{i // 10}") == pytest.approx(score(lambda i: None))
