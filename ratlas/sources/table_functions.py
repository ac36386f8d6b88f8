"""Parsers of portal pages as table functions for SQL: rows leave a page one by one, by LATERAL.

    SELECT p.page_id, r.* FROM pages p, LATERAL month_rows(p.html, 2025, 10) r
    SELECT p.page_id, i.* FROM pages p, LATERAL agenda_rows(p.html) i
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ratlas.sources.html_tables import detail_rows, documents_in, overview_rows, tree

_INT, _STR = IntegerType(), StringType()


def _columns(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


#: The columns of each function, which analyze gives to Spark.
MONTH = _columns(place=_INT, committee=_STR, meeting_name=_STR, href=_STR, day_texts=ArrayType(_STR), start_time=_STR, location=_STR, year=_INT, month=_INT)
AGENDA = _columns(place=_INT, number=_STR, text=_STR, status=_STR, documents=_INT, first_href=_STR)
DOCUMENTS = _columns(place=_INT, href=_STR, title=_STR)


def _asks_for(schema: StructType, *arguments: AnalyzeArgument | None, kinds: tuple[str, ...]) -> AnalyzeResult:
    for i, (a, kind) in enumerate(zip(arguments, kinds, strict=True), 1):
        if a is None or a.isTable or a.dataType.simpleString() not in (kind, "void"):
            raise ValueError(f"argument {i} must be {kind}")
    return AnalyzeResult(schema)


class MonthRows:
    """The sessions of a month's page in page order; dates are still text, beside the year and month they are read by."""

    @staticmethod
    def analyze(html: AnalyzeArgument, year: AnalyzeArgument, month: AnalyzeArgument) -> AnalyzeResult:
        return _asks_for(MONTH, html, year, month, kinds=("string", "int", "int"))

    def eval(self, html: str, year: int, month: int) -> Iterator[tuple]:
        for i, r in enumerate(overview_rows(html)):
            yield (i, *[r[c] for c in ("committee", "meeting_name", "href", "day_texts", "start_time", "location")], year, month)


class AgendaRows:
    """The agenda items of a session's page in page order, with the number of their documents and the first one."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _asks_for(AGENDA, html, kinds=("string",))

    def eval(self, html: str) -> Iterator[tuple]:
        for i, r in enumerate(detail_rows(html)[0]):
            yield (i, r["number"], r["text"], r["status"], len(r["documents"]), r["documents"][0]["href"] if r["documents"] else None)


class DocumentLinks:
    """The document links of a page, one an address, in page order."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _asks_for(DOCUMENTS, html, kinds=("string",))

    def eval(self, html: str) -> Iterator[tuple]:
        for i, d in enumerate(documents_in(tree(html))):
            yield i, d["href"], d["title"]


def register(spark: SparkSession) -> None:
    """month_rows, agenda_rows and document_links for SQL."""
    from pyspark.sql.functions import udtf

    for name, f in (("month_rows", MonthRows), ("agenda_rows", AgendaRows), ("document_links", DocumentLinks)):
        spark.udtf.register(name, udtf(f))
