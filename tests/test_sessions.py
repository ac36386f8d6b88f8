import datetime as dt

import pytest

from ratlas import schemas
from ratlas.functions import dates
from ratlas.operators import sessions as s

TODAY = "2019-11-14"


@pytest.fixture(scope="module")
def council(spark):
    rows = [("h1", "2019-09-03", "Beirat Nordufer", "Hafenrunde"), ("h2", "2019-11-14", "Beirat Nordufer", "Lichterabend"), ("h3", "2020-01-08", "Werkausschuss", "Deichpflege vor Ort"), ("h4", None, "Beirat Nordufer", "Termin offen")]
    sessions = spark.createDataFrame(rows, "session_id string, date string, committee string, meeting_name string").withColumn("session_path", s.F.lit(""))
    agenda = spark.createDataFrame([(1, "h1", "Ö 1", None), (2, "h1", "Ö 1", "Zweiter"), (3, "h2", "Ö 1", "b"), (4, "h3", "Ö 1", "c"), (5, "h3", "Ö 2", "d")], "id bigint, session_id string, number string, title string")
    docs = spark.createDataFrame(
        [(1, "h1", "Brunnen am Kornmarkt", "BV", "beschlussvorlage", "Ö 1", "u1", " "), (2, "h1", "Deichplan", None, None, None, "u2", "a.pdf"), (3, "x9", "Brunnen 100%", None, "protokoll", "Ö 1", "u3", "b.pdf")],
        "id bigint, session_id string, title string, category string, document_type string, agenda_item string, url string, local_path string",
    ).withColumn("content_type", s.F.lit("application/pdf"))
    return sessions, agenda, docs


def ids(df, c="session_id"):
    return [r[c] for r in df.collect()]


def test_listing_filters(council):
    sessions, agenda, _ = council
    found = lambda **f: ids(s.listing(sessions, agenda, s.Filters(**f), TODAY))
    assert found(status="heute", search="LICHTER") == ["h2"] and found(status="heute", search="deich") == []
    assert found(committee="Beirat Nordufer", date_to="2019-10-31") == ["h1"] and found(search="%_runde") == ["h1"]
    assert found(date_from="2019-11-14", date_to="2020-12-31") == ["h3", "h2"]
    assert [(r.session_id, r.top_count, r.session_status) for r in s.listing(sessions, agenda, today=TODAY).collect()] == [("h3", 2, "kommend"), ("h2", 1, "heute"), ("h1", 2, "vergangen"), ("h4", 0, "kommend")]


def test_presets():
    day = dt.date(2024, 2, 10)  # a leap year's day lies in the range
    assert dates.preset("Heute", day) == ("2024-02-10", "2024-02-10")
    assert dates.preset("Naechste 30 Tage", day) == ("2024-02-10", "2024-03-11")
    assert dates.preset("Letzte 30 Tage", day) == ("2024-01-11", "2024-02-10")
    assert dates.preset("Dieses Jahr", day) == ("2024-01-01", "2024-12-31")


def test_overview_counts_children_apart(council):
    rows = s.overview(*council).collect()
    assert {r.session_id: (r.top_count, r.document_count) for r in rows} == {"h1": (2, 2), "h2": (1, 0), "h3": (2, 0), "h4": (0, 0)}


def test_search(council):
    sessions, _, docs = council
    found = s.search(docs, sessions, "brunnen  NORDUFER").collect()
    assert [(r.id, r.display_date, r.display_type) for r in found] == [(1, "03.09.2019", "beschlussvorlage")]
    assert ids(s.search(docs, sessions, "100%"), "id") == [3]
    assert s.search(docs, sessions, "  ").count() == 0


def test_scope_asymmetry(council):
    sessions, agenda, docs = council
    assert sorted(ids(s.scope_documents(docs, sessions, "h1", "tops", []), "id")) == [1, 2]
    assert ids(s.scope_documents(docs, sessions, "h1", "tops", ["Ö 1"]), "id") == [1]
    assert s.agenda_in_scope(agenda, "tops", []).count() == 0


def test_first_title_may_be_null(council):
    assert {(r.session_id, r.number): r.title for r in s.first_titles(council[1]).collect()}[("h1", "Ö 1")] is None


def test_export(council):
    sessions, agenda, docs = council
    out = s.export_batch(docs, sessions, agenda, ["h1"], types=["beschlussvorlage"]).collect()
    assert [(r.id, r.top_title) for r in out] == [(1, None)]
    assert s.export_batch(docs, sessions, agenda, require_path=True).count() == 1
    with pytest.raises(ValueError):
        s.export_batch(docs, sessions, agenda, types=["brief"])
    with pytest.raises(ValueError):
        s.export_batch(docs, sessions, agenda, date_from="14.11.2019")


def test_documents_by_agenda(council):
    _, agenda, docs = council
    out = {r.id: (r.document_count, r.available_count) for r in s.by_agenda(agenda, docs).collect()}
    assert out == {1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_display(spark):
    rows = [("a", "Ausschuss-für-Bildung", "", ""), ("b", "", "", "data/raw/2019/11/2019-11-14-Beirat-Hafenviertel-7"), ("c", None, None, "data/raw/2019/11/2019-11-14_Beirat_Nordufer_8"), ("d", "Rat-der-Stadt", "Sondersitzung", "")]
    df = spark.createDataFrame(rows, "session_id string, committee string, meeting_name string, session_path string").withColumn("date", s.F.lit("2019-11-14"))
    assert [r.display_name for r in s.display(df).orderBy("session_id").collect()] == ["Ausschuss für Bildung", "Beirat Hafenviertel", "Beirat Nordufer", "Sondersitzung"]


def test_schemas_conform(spark):
    df = schemas.conform(spark.createDataFrame([("1",)], "session_id string"), schemas.SESSIONS)
    assert df.columns[:2] == ["session_id", "date"] and df.first().date is None
    assert schemas.empty(spark, schemas.VECTORS).count() == 0


def test_source_availability(council, spark):
    sessions, _, docs = council
    files = spark.createDataFrame([("a.pdf",), ("a.pdf",)], "path string")
    assert {r.id: r.source_available for r in s.source_availability(docs, sessions, files).collect()} == {1: False, 2: True, 3: False}
