"""Sessions, agenda items and documents from portal pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.functions import dates, text, urls

#: Pages that a task holds as Python's objects at a time.
ROWS = 256
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening element ends, if it is still open as the innermost one.
_ENDS = {"tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}}


#: Elements whose content isn't markup.
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: A tag without anything unusual, or text; and an attribute. Pages that hold anything else are left to HTMLParser.
_VALUE = r"""'[^'&]*(?:&amp;[^'&]*)*'|"[^"&]*(?:&amp;[^"&]*)*"|[^ \t\n\r\f"'<>=&`/]+(?![^ \t\n\r\f>])"""
_TOKEN = re.compile(rf"([^<]+)|<([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9_-]*(?:=(?:{_VALUE}))?)*+)[ \t\n\r\f]*(/?)>|</([A-Za-z][A-Za-z0-9]*)[ \t\n\r\f]*>|<")
_UNUSUAL = re.compile(rf"<(?:[!?]|(?:{'|'.join(sorted(_RAW))})\b)", re.IGNORECASE)
_ATTRIBUTE = re.compile(rf"([A-Za-z][A-Za-z0-9_-]*)(?:=({_VALUE}))?")


class Node:
    """An element: its place in the page's items (elements and texts in their order), and where what is in it ends."""

    __slots__ = ("attrs", "end", "items", "place", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], items: list[Node | str], place: int):
        self.tag, self.attrs, self.items, self.place, self.end = tag, attrs, items, place, place + 1

    def walk(self) -> list[Node]:
        return [n for n in self.items[self.place + 1 : self.end] if n.__class__ is Node]

    def all(self, tag: str = "", cls: str = "", id: str = "") -> list[Node]:
        out = [n for n in self.items[self.place + 1 : self.end] if n.__class__ is Node and (n.tag == tag or not tag)]
        if cls:
            out = [n for n in out if cls in n.attrs.get("class", "").split()]
        return [n for n in out if n.attrs.get("id") == id] if id else out

    def first(self, tag: str = "", cls: str = "", id: str = "") -> Node | None:
        return next(iter(self.all(tag, cls, id)), None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def strings(self) -> list[str]:
        return [x for x in self.items[self.place + 1 : self.end] if x.__class__ is str]

    def text(self, by: str = "") -> str:
        return by.join(self.strings())

    def above(self) -> Iterator[Node]:
        return (n for n in reversed(self.items[: self.place]) if n.__class__ is Node and n.end > self.place)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[Node | str] = []
        self.open = [Node("", {}, self.items, 0)]
        self.items.append(self.open[0])

    def _shut(self, at: int) -> None:
        open_, end = self.open, len(self.items)
        while len(open_) > at:
            open_.pop().end = end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open[-1].tag in _ENDS.get(tag, ()):
            self._shut(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.items, len(self.items))
        self.items.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.items, len(self.items)))

    def handle_endtag(self, tag: str) -> None:
        open_, at = self.open, len(self.open) - 1
        while at and open_[at].tag != tag:
            at -= 1
        if at:
            self._shut(at)

    def handle_data(self, data: str) -> None:
        if data := data.strip():
            self.items.append(data)

    def plain(self, html: str) -> bool:
        """Takes a page of usual tags and texts; False, with part of it taken, if it holds anything else."""
        if html.rfind("&") > html.rfind("<") or _UNUSUAL.search(html):
            return False
        items, open_, put, ends = self.items, self.open, self.items.append, _ENDS.get
        for data, tag, attrs, alone, ended in _TOKEN.findall(html):
            if data:
                if data := (unescape(data) if "&" in data else data).strip():
                    put(data)
            elif ended:
                if open_[-1].tag == (ended := ended.lower()):
                    open_.pop().end = len(items)
                else:
                    self.handle_endtag(ended)
            elif not (tag := tag.lower()) or tag in _RAW:
                return False
            else:
                if not alone and (over := ends(tag)):
                    while open_[-1].tag in over:
                        open_.pop().end = len(items)
                found = {k.lower(): (v[1:-1] if v[:1] in ("'", '"') else v).replace("&amp;", "&") for k, v in _ATTRIBUTE.findall(attrs)} if attrs else {}
                put(node := Node(tag, found, items, len(items)))
                if not alone and tag not in _VOID:
                    open_.append(node)
        return True


def tree(html: str | None) -> Node:
    parser = _Tree()
    if not parser.plain(html or ""):
        parser = _Tree()
        parser.feed(html or "")
        parser.close()
    root = parser.open[0]
    parser._shut(0)
    return root


def overview_rows(html: str | None) -> list[dict]:
    """Rows of a month's page that name a session and link to it; the date is still text."""
    root, out = tree(html), []
    table = root.first("table", id="smc_page_si0040_contenttable1")
    for row in table.all("tr") if table else ():
        cell = row.first("td", "silink")
        link, header = (cell.first("a", "smc-link-normal"), cell.first("div", "smc-el-h")) if cell else (None, None)
        title = (link or header).text() if link or header else ""
        if not title or not link or not link.attrs.get("href"):
            continue
        day, items = row.first("span", "weekday"), [li.text() for ul in cell.all("ul") for li in ul.all("li")]
        hints = [v for a in row.all("a") for k in ("title", "aria-label") if (v := a.attrs.get(k))]
        out.append({"committee": header.text() if header else title, "meeting_name": title, "href": link.attrs["href"], "day_texts": [day.text() if day else "", *hints], "start_time": (items or [None])[0], "location": items[1] if len(items) > 1 else None})
    root.items.clear()  # elements know their page's items, so they would wait for the garbage collector
    return out


def documents_in(node: Node) -> list[dict]:
    """Document links in a node, one an address, at the place of its first link; a visible title comes before none."""
    found: dict[str, dict] = {}
    for a in node.all("a"):
        href, seen = a.attrs.get("href", ""), a.text()
        if "type=do" not in href.lower() and "getfile.asp" not in href.lower():
            continue
        new = {"href": href, "title": seen or a.attrs.get("title") or "Dokument", "visible": bool(seen)}
        if href not in found:
            found[href] = new
        elif new["visible"] and not found[href]["visible"]:
            found[href].update(new)
    return [{"href": d["href"], "title": d["title"]} for d in found.values()]


def _is_agenda(n: Node) -> bool:
    return "Tagesordnung" in n.attrs.get("class", "") + " " + n.attrs.get("id", "") or n.attrs.get("summary") == "Tagesordnung" or n.attrs.get("id") == "smc_page_si0057_contenttable2" or "smctablesitzung" in n.attrs.get("class", "")


def agenda_table(root: Node) -> Node | None:
    """The agenda by class, then id, then summary, then the portal's own names."""
    tables = root.all("table")
    tests = (
        lambda t: "Tagesordnung" in t.attrs.get("class", ""), lambda t: "Tagesordnung" in t.attrs.get("id", ""), lambda t: t.attrs.get("summary") == "Tagesordnung",
        lambda t: "smctablesitzung" in t.classes, lambda t: t.attrs.get("id") == "smc_page_si0057_contenttable2",
    )
    return next((t for test in tests for t in tables if test(t)), None)


def detail_rows(html: str | None) -> tuple[list[dict], list[dict]]:
    """Agenda items (number, text, status, documents) and the documents of the session itself (with category)."""
    root, items, own = tree(html), [], []
    table = agenda_table(root)
    for row in table.all("tr") if table else ():
        cells = row.all("td")
        if len(cells) >= 2:
            items.append({"number": cells[0].text(), "text": cells[1].text("\n"), "status": cells[2].text() if len(cells) > 2 else None, "documents": documents_in(cells[-1])})
    for block in (b for d in root.all("div", "smc-documents") for b in d.all("div", "smc-dg-ds-1")):
        parent = next((n for n in block.above() if n.tag == "table"), None)
        content = block.first("div", "smc-doc-content")
        if content and not (parent and _is_agenda(parent)):
            icon = next((i for d in block.all("div", "smc-doc-icon") for i in d.all("i")), None)
            own += [{**d, "category": (icon.text() or None) if icon else None} for d in documents_in(content)]
    root.items.clear()
    return items, own


def _parsed(column: str, kind: pa.DataType, parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "html"]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = pa.array([parse(h) for h in part.column("html").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], rows], names=[*rest, column])

    return run


_STR = pa.string()
_DOCS = pa.list_(pa.struct([("href", _STR), ("title", _STR)]))
_OVERVIEW = pa.list_(pa.struct([("committee", _STR), ("meeting_name", _STR), ("href", _STR), ("day_texts", pa.list_(_STR)), ("start_time", _STR), ("location", _STR)]))
_DETAIL = pa.struct([("items", pa.list_(pa.struct([("number", _STR), ("text", _STR), ("status", _STR), ("documents", _DOCS)]))), ("own", pa.list_(pa.struct([("href", _STR), ("title", _STR), ("category", _STR)])))])
_DOCS_SQL = "array<struct<href:string,title:string>>"


def overview_sessions(pages: DataFrame, base: str, keep: Sequence[str] = ()) -> DataFrame:
    """pages (page_id, year, month, html) -> sessions in page order; rows without a readable date are left out. keep: further
    columns of pages that their sessions have too."""
    row = "struct<committee:string,meeting_name:string,href:string,day_texts:array<string>,start_time:string,location:string>"
    kinds = dict(pages.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in keep)
    df = pages.select("page_id", "year", "month", *keep, "html").mapInArrow(_parsed("rows", _OVERVIEW, overview_rows), f"page_id {kinds['page_id']}, year int, month int{more}, rows array<{row}>")
    df = df.select("page_id", "year", "month", *keep, F.posexplode("rows").alias("place", "r")).withColumn("detail_url", urls.absolute(base, F.col("r.href")))
    days = F.transform("r.day_texts", lambda t: dates.day_value(t, F.col("year"), F.col("month")))
    df = df.withColumn("day", F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))).where("day IS NOT NULL")
    return df.select("page_id", "place", "r.committee", "r.meeting_name", urls.session_id(F.col("detail_url")).alias("session_id"), F.col("day").cast("string").alias("date"), "r.start_time", "detail_url", "r.location", *keep)


def session_details(pages: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """pages (session_id, html) -> (agenda items with title, reporter, decision; documents of agenda and session)."""
    detail = f"struct<items:array<struct<number:string,text:string,status:string,documents:{_DOCS_SQL}>>,own:array<struct<href:string,title:string,category:string>>>"
    df = pages.select("session_id", "html").mapInArrow(_parsed("detail", _DETAIL, lambda h: dict(zip(("items", "own"), detail_rows(h), strict=True))), f"session_id {dict(pages.dtypes)['session_id']}, detail {detail}")
    items = df.select("session_id", F.posexplode("detail.items").alias("place", "i"))
    title, reporter = text.title_and_reporter(F.col("i.text"))
    agenda = items.select(
        "session_id", "place", "i.number", F.coalesce(text.filled(title), text.filled(text.collapse(F.col("i.text"))), F.lit("Tagesordnungspunkt")).alias("title"), reporter.alias("reporter"), "i.status",
        text.decision(F.col("i.status")).alias("decision"), (F.size("i.documents") > 0).cast("int").alias("documents_present"),
    )
    doc = lambda part, place, d, category, item: F.struct(part.alias("part"), place.alias("place"), d["title"].alias("title"), d["href"].alias("href"), category.alias("category"), item.alias("agenda_item"))
    null = F.lit(None).cast("string")
    own = F.transform("detail.own", lambda d, i: doc(F.lit(0), i, d, d["category"], null))
    of_items = F.flatten(F.transform("detail.items", lambda x, p: F.transform(x["documents"], lambda d, i: doc(p + 1, i, d, null, text.filled(x["number"])))))
    documents = df.select("session_id", F.explode(F.concat(own, of_items)).alias("d"))  # of one reading of the pages, which are parsed once
    documents = documents.select("session_id", "d.part", "d.place", "d.title", urls.absolute(base, F.col("d.href")).alias("url"), "d.category", "d.agenda_item")
    return agenda, documents


def links(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> every anchor with an address in page order: page_id, place, href, title."""
    kind = pa.list_(pa.struct([("href", _STR), ("title", _STR)]))
    parse = lambda h: [{"href": a.attrs["href"], "title": a.text()} for a in tree(h).all("a") if "href" in a.attrs]
    df = pages.select("page_id", "html").mapInArrow(_parsed("links", kind, parse), f"page_id {dict(pages.dtypes)['page_id']}, links {_DOCS_SQL}")
    return df.select("page_id", F.posexplode("links").alias("place", "l")).select("page_id", "place", "l.href", "l.title")


def dedupe_links(found: DataFrame) -> DataFrame:
    """One row for each page and address: the place of its first link, the first visible title else the first title."""
    order = F.struct((F.col("title") == "").cast("int"), F.col("place"))
    return found.groupBy("page_id", "href").agg(F.min("place").alias("place"), F.min_by("title", order).alias("title"))
