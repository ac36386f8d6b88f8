import pytest
from pyspark.sql import functions as F

from ratlas.functions import dates, jsonx, text, urls


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_document_types(spark):
    rows = [("Protokoll öffentlich", "PR"), ("Beschlussprotokoll Vorlage", None), ("x", "bv"), ("Einladung", "zz"), (None, None), ("Vorlage", " ")]
    got = values(spark, rows, "t string, c string", text.document_type(F.col("t"), F.col("c"), F.lit(None).cast("string"), F.lit(""), F.lit("")))
    assert got == ["protokoll", "protokoll", "beschlussvorlage", "sonstiges", "sonstiges", "vorlage"]


def test_decisions_keep_their_quirks(spark):
    rows = [("nicht beschlossen",), ("zurückgestellt",), ("Ohne Beschluss",), (None,), ("",), ("ABGELEHNT",)]
    assert values(spark, rows, "s string", text.decision(F.col("s"))) == ["accepted", None, "rejected", None, None, "rejected"]


def test_title_and_reporter(spark):
    rows = [("Genehmigung des Protokolls\nBerichterstatter: Ratsvorsitzender Boßmann",), ("Haushalt 2025 - Berichterstatterin: Fachbereich Finanzen",), ("Verschiedenes",)]
    t, r = text.title_and_reporter(F.col("x"))
    got = spark.createDataFrame(rows, "x string").select(t, r).collect()
    assert [tuple(x) for x in got] == [("Genehmigung des Protokolls", "Ratsvorsitzender Boßmann"), ("Haushalt 2025", "Fachbereich Finanzen"), ("Verschiedenes", None)]


def test_slugs(spark):
    assert values(spark, [("Straße & Öl",), ("--",), ("a" * 50,)], "x string", text.file_slug(F.col("x"), 20))[:2] == ["Straße-Öl", "document"]
    assert values(spark, [("Über Çafé (7)",)], "x string", text.ascii_slug(F.col("x"))) == ["Ueber-Cafe-7"]
    assert values(spark, [(" Mein Prompt! ",), ("!!",)], "x string", text.prompt_id_slug(F.col("x"))) == ["mein_prompt", "prompt_vorlage"]
    name = text.document_file_name(F.col("x"), F.lit("u"), F.lit(7), F.lit(".pdf"))
    assert values(spark, [("Plan A",)], "x string", name)[0].startswith("Plan-A-007-")


TEXT = "Beschlussvorschlag: Der Rat stimmt zu.\nBegruendung: Es ist nötig.\n\nFinanzielle Auswirkungen: 350.000 EUR\nZustaendigkeit: Bildung"


def test_sections(spark):
    rows = [("Beschlussvorlage", TEXT, "T"), ("vorlage", "Begruendung: kurz", ""), ("protokoll", "Beratung: lang\nBeschluss: ja\nAbstimmung: einstimmig", None), ("bekanntmachung", TEXT, "T"), ("protokoll", " ", None), ("vorlage", "Begründung: nein", None)]
    c = text.parse_content(F.col("k"), F.col("t"), F.col("n"))
    got = spark.createDataFrame(rows, "k string, t string, n string").select(c.alias("c")).select("c.*").collect()
    assert [(r.status, r.quality) for r in got] == [("ok", "high"), ("ok", "low"), ("ok", "high"), ("unsupported_document_type", "failed"), ("empty_text", "failed"), ("no_structured_fields", "failed")]
    assert got[0].fields["finanzbezug"] == "350.000 EUR" and got[0].fields["titel"] == "T" and got[0].fields["begruendung"] == "Es ist nötig."
    assert got[1].fields == {"begruendung": "kurz"}
    assert got[2].fields["entscheidung"] == "ja\nAbstimmung: einstimmig"


def test_headings(spark):
    got = values(spark, [("Beschluss: a Finanzielle Auswirkungen :  b",), ("",), (None,)], "t string", text.section_headings(F.col("t")))
    assert [(h.heading, h.anchor_text) for h in got[0]] == [("Beschluss", "Beschluss: a Finanzielle Auswirkungen : b"), ("Finanzielle Auswirkungen", "Finanzielle Auswirkungen : b")]
    assert got[1] == [] and not got[2]


@pytest.mark.parametrize(("raw", "day"), [("Mi, 04.03.2026", "2026-03-04"), ("Fr., 20.03.26", "2026-03-20"), ("4.", "2025-10-04"), ("12", "2025-10-12"), ("7.11.", "2025-11-07"), ("31.02.2026", None), ("-", None), ("", None)])
def test_day_values(spark, raw, day):
    got = values(spark, [(raw,)], "x string", dates.day_value(F.col("x"), F.lit(2025), F.lit(10)).cast("string"))
    assert got == [day]


def test_dates(spark):
    rows = [("2026-03-11T10:00:00Z",), ("bald",), (None,)]
    assert values(spark, rows, "x string", dates.german(F.col("x"))) == ["11.03.2026", "bald", ""]
    assert values(spark, [("2026-03-11",), ("x",), ("",)], "x string", dates.session_state(F.col("x"), "2026-03-11")) == ["heutige Sitzung", "Datum nicht auswertbar", "Datum unbekannt"]


def test_urls(spark):
    rows = [("https://x/si.asp?__ksinr=41205",), ("https://x/a.asp?SID=&__kvid=5",), ("https://x/y",)]
    assert values(spark, rows, "u string", urls.session_id(F.col("u"))) == ["41205", "5", "https://x/y"]
    same = values(spark, [("Ö 1",), ("Ö 2",), ("",), (None,), ("Ö 1",)], "a string", urls.stable_id(F.lit("1"), F.lit("u"), F.col("a")))
    assert len(set(same)) == 3 and same[0] == same[4] and same[2] == same[3]
    rows = [("application/pdf; q=1", None, "u", ""), (None, 'attachment; filename="a.docx"', "u", ""), (None, None, "https://x/b.ASP?x=1", "ein PDF"), (None, None, "https://x/b.txt", ""), (None, None, "https://x/getfile.asp", "")]
    got = values(spark, rows, "m string, d string, u string, t string", urls.extension(F.col("m"), F.col("d"), F.col("u"), F.col("t")))
    assert got == [".pdf", ".docx", ".pdf", ".txt", ".bin"]
    assert values(spark, [("attachment; filename*=UTF-8''%C3%96l.pdf",)], "d string", urls.disposition_name(F.col("d"))) == ["Öl.pdf"]
    assert values(spark, [(" 12 ",), ("-1",), ("x",), (None,)], "x string", urls.content_length(F.col("x"))) == [12, None, None, None]


def test_responses(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 1}\n```',), ("kein json",), ("[1]",), (None,)]
    assert values(spark, rows, "x string", jsonx.response_object(F.col("x"))) == ['{"a": 1}', '{"a": 1}', "{}", "{}", "{}"]
    assert values(spark, [(" Yes ",), ("off",), (None,), ("",), ("x",)], "x string", jsonx.tolerant_bool(F.col("x"))) == [True, False, True, False, True]
    assert values(spark, [("3",), ("0",), ("x",), (None,)], "x string", jsonx.tolerant_int(F.col("x"))) == [3, 1, 1, 1]


def test_templates(spark):
    got = values(spark, [("{{a}} {{ b }} {{c}}",)], "x string", text.render_template(F.col("x"), {"a": F.lit("1"), "b": F.lit(None).cast("string")}))
    assert got == ["1  {{c}}"]
    assert values(spark, [("a\n## Prompt-Hinweis\nb\nc",)], "x string", text.without_hint(F.col("x"))) == ["a"]
