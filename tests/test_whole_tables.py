"""Queries that leave out no row and no part of a text, on small tables of their own."""

import datetime
import hashlib
import re

from ratlas.functions import text
from ratlas.plans.queries import QUERIES


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_missing_has_no_limit(spark, tmp_path):
    written(spark, tmp_path, "labels", [(i, 1, 0) for i in range(5)], "doc_id bigint, quality int, toxic int")
    folder = written(spark, tmp_path, "documents", [(i, "en") for i in range(75)], "doc_id bigint, lang string")
    assert sorted(r.doc_id for r in QUERIES["missing_left_anti"](spark, folder).collect()) == list(range(5, 75))


def test_leap_days_are_null(spark, tmp_path):
    leap = datetime.datetime(1996, 2, 29)
    folder = written(spark, tmp_path, "orders", [(i, leap) for i in range(5)] + [(7, datetime.datetime(1996, 3, 1))], "o_orderkey bigint, o_orderdate timestamp")
    got = {r.o_orderkey: r.day for r in QUERIES["day_value_parse"](spark, folder).collect()}
    assert got == {0: "1996-02-29", 1: "1996-02-29", 2: None, 3: None, 4: None, 7: "2026-03-01"}


def test_chars_of_whole_texts(spark, tmp_path):
    folder = written(spark, tmp_path, "documents", [(1, "ab " * 30_000), (2, None), (3, "x" * 40_001)], "doc_id bigint, text string")
    got = {r.doc_id: (r.chars, r.status, r.quality) for r in QUERIES["text_quality"](spark, folder).collect()}
    assert got == {1: (89_999, "ok", "high"), 2: (0, "empty_text", "failed"), 3: (40_001, "ok", "high")}
    cut = text.text_quality(text.F.col("text"), 40_000, text.F.lit(False))
    assert {r.n for r in spark.createDataFrame([("ab " * 30_000,)], "text string").select(cut["chars"].alias("n")).collect()} == {40_000}


def brute_section(body, labels, stops):
    """What follows the first label up to the first stop label behind it, by looking at every place."""
    word = lambda s, i: 0 <= i < len(s) and bool(re.match(r"\w", s[i]))
    at = lambda names, i: next((x for x in names if body[i : i + len(x)].lower() == x.lower() and not word(body, i - 1) and not word(body, i + len(x))), None)
    for i in range(len(body)):
        if label := at(labels, i):
            rest = re.sub(r"^\s*[:\-]?\s*", "", body[i + len(label) :])
            start = len(body) - len(rest)
            end = next((j for j in range(start, len(body)) if at(stops, j)), len(body))
            return body[start:end].strip() or None
    return None


def test_sections_of_whole_texts(spark, tmp_path):
    long = "Der Rat prüft Ärger, ÖPNV und 350.000 EUR. " * 400
    texts = [long, long + "Anlagen: drei. " + long, "kurz", None, "", long + "ABSTIMMUNG - einstimmig " + long, "É Sachverhalt: " + long + " Zustaendigkeit: x", long.upper()]
    rows = [(3 * i + k, t, "s") for i, t in enumerate(texts) for k in range(3)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in QUERIES["labelled_sections"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, names = got[i], text.SECTIONS.get(("vorlage", "protokoll", None)[i % 3], {})
        body = re.sub(r"\n{2,}", "\n", f"Beschlussvorschlag: {t or ''}\nBegruendung: {t or ''}").strip()
        body = re.sub(r"[ \t]+", " ", body)
        want = {x: v for x, (labels, stops) in names.items() if (v := brute_section(body, labels, stops))}
        assert r.sections == ",".join(sorted(want)), i
        for x in ("beschlusstext", "begruendung"):
            v = want.get(x)
            assert (r[f"{x}_chars"], r[f"{x}_sha256"]) == ((len(v), hashlib.sha256(v.encode()).hexdigest()) if v else (None, None)), (i, x)
    assert got[0].beschlusstext_chars > 10_000
