"""Downloads as a flow of tables: what to ask for, what to fetch again, where it is stored, and what the manifest says.

The functions that fetch are passed in; nothing here opens a connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratlas.functions import text, urls
from ratlas.operators import index

#: Fields of a month's request; most bytes of a document, and from where it counts as large.
MONTH_FIELDS = {"month": "%02d", "year": "%d", "__cjahr": "%d", "__cmonat": "%02d", "__cmandant": "2", "__canz": "1", "__cselect": "0"}
MOST_BYTES = 100 * 1024 * 1024
LARGE_BYTES = 25 * 1024 * 1024

Answer = tuple[bytes, dict[str, str]]


def month_requests(months: DataFrame) -> DataFrame:
    """months (year, month) with params, the fields of each month's request."""
    value = lambda name, form: F.format_string(form, "month" if "mon" in name else "year") if "%" in form else F.lit(form)
    return months.withColumn("params", F.create_map(*[c for name, form in MONTH_FIELDS.items() for c in (F.lit(name), value(name, form))]))


def landed(pages: DataFrame, path: str) -> None:
    """Keep raw pages (with year) as they came, one folder a year: a page that is read again needs no request."""
    pages.write.mode("append").partitionBy("year").parquet(path)


def _asked(ask: Callable[[str], Answer], url: str, attempts: int, wait: float, factor: float) -> tuple[Answer | None, str | None]:
    error = None
    for i in range(attempts):
        try:
            return ask(url), None
        except Exception as e:  # whatever a fetcher raises belongs to its address
            error = str(e)
            if i + 1 < attempts:
                time.sleep(wait * factor**i)
    return None, error


def fetched(documents: DataFrame, fetch: Callable[[str], Answer], most: int = MOST_BYTES, attempts: int = 1, wait: float = 1.0, factor: float = 2.0) -> DataFrame:
    """url, content, headers (names in lower case), large, error: every address once, however many documents have it.

    Above `most` bytes, by the header or by the content, there is an error and no content. A fetch that raises is tried
    again after `wait` seconds, then `factor` times that. Null and empty addresses are left out. Each address is a batch
    of its own, so a task holds one document. Save the result before reading it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                answer, error = _asked(fetch, url, attempts, wait, factor)
                content, headers = answer or (None, {})
                headers = {k.lower(): v for k, v in headers.items()}
                said = headers.get("content-length", "").strip()
                size = max(int(said) if said.isascii() and said.isdigit() else 0, len(content or b""))
                if size > most:
                    content, error = None, f"document exceeds size limit ({size} > {most} bytes)"
                kinds = [pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string()]
                row = [url, content, list(headers.items()), size > LARGE_BYTES, error]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["url", "content", "headers", "large", "error"])

    asked = documents.select("url").where("url <> ''").distinct()
    return asked.mapInArrow(run, "url string, content binary, headers map<string,string>, large boolean, error string")


def probed(documents: DataFrame, head: Callable[[str], dict[str, str]]) -> DataFrame:
    """url, headers (names in lower case) of every address once; a probe that fails gives no headers."""
    found = fetched(documents, lambda url: (b"", {k: v for k, v in head(url).items()}), most=2**62)
    return found.select("url", F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"))


def _header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def planned(documents: DataFrame, entries: DataFrame, heads: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (session_id, url, agenda_item, title, category) with entry, headers and action: 'reuse' where the
    manifest's entry has a file in the listing (session_id, path) and the headers say that it is current, else 'fetch'.

    entries have the keys of a document, session_id, path, etag, last_modified, content_length and place.
    """
    there = files.select(F.col("session_id").alias("__s"), F.col("path").alias("__p")).distinct()
    said = heads.select(F.col("url").alias("__url"), "headers", urls.header_value(_header("etag")).alias("__tag"), urls.header_value(_header("last-modified")).alias("__stamp"), urls.content_length(_header("content-length")).alias("__length"))
    df = index.match_manifest(documents, entries, by=("session_id",))
    # what is compared travels as plain columns, so that whole entries and headers travel only where they are asked for
    df = df.select("*", F.col("entry.path").alias("__path"), *[urls.header_value(F.col(f"entry.{c}")).alias(f"__{c}") for c in ("etag", "last_modified")], F.col("entry.content_length").alias("__size"))
    df = df.join(said, F.col("url") == F.col("__url"), "left").drop("__url")
    same = urls.unchanged(*map(F.col, ("__etag", "__tag", "__last_modified", "__stamp", "__size", "__length")))
    df = df.withColumn("__same", same).drop("__tag", "__stamp", "__length", "__etag", "__last_modified", "__size")
    df = df.join(there, (F.col("session_id") == F.col("__s")) & (F.col("__path") == F.col("__p")), "left")
    found = F.col("__p").isNotNull()
    return df.withColumn("entry", F.when(found, F.col("entry"))).withColumn("action", F.when(found & F.col("__same"), "reuse").otherwise("fetch")).drop("__s", "__p", "__path", "__same")


def named(documents: DataFrame) -> DataFrame:
    """Fetched documents (session_id, url, title, place, headers, old_path, agenda_number, agenda_title) with path, below
    the session's folder: an old path stays; new files count from 1 within their session, its own documents before those
    of its agenda items, each in the order of place."""
    of_item = F.col("agenda_number").isNotNull() | F.col("agenda_title").isNotNull()
    fresh = F.col("old_path").isNull()
    number = F.sum(fresh.cast("int")).over(Window.partitionBy("session_id").orderBy(of_item, "place", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    folder = F.when(of_item, F.concat(F.lit("agenda/"), text.agenda_directory(F.col("agenda_number"), F.coalesce("agenda_title", F.lit(""))))).otherwise("session-documents")
    new = F.concat(folder, F.lit("/"), text.document_file_name(F.col("title"), F.col("url"), F.col("__n"), F.col("__end")))
    ending = urls.extension(_header("content-type"), _header("content-disposition"), F.col("url"), F.col("title"))
    df = documents.withColumn("__end", ending).withColumn("__n", number)  # headers needn't meet the other documents of a session
    return df.withColumn("path", F.when(fresh, new).otherwise(F.col("old_path"))).drop("__n", "__end")


def entries(stored: DataFrame) -> DataFrame:
    """Stored documents (session_id, title, category, agenda_item, url, path, content, headers) as entries of a manifest;
    a length that the headers lack, or that is 0, is the content's own."""
    length = F.coalesce(F.nullif(urls.content_length(_header("content-length")), F.lit(0)), F.octet_length("content").cast("long"))
    return stored.select(
        "session_id", "title", "category", "agenda_item", "url", "path", F.sha1("content").alias("sha1"), _header("content-type").alias("content_type"), _header("content-disposition").alias("content_disposition"),
        length.alias("content_length"), _header("etag").alias("etag"), _header("last-modified").alias("last_modified"),
    )
