"""Addresses, headers and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratlas.functions.text import as_text, filled

#: Query fields that hold a session's id, the first that is there.
SESSION_FIELDS = ("SID", "SILFDNR", "__kvid", "__ksinr")
#: Extensions of media types.
EXTENSIONS = {
    "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "text/plain": ".txt",
    "text/html": ".html", "image/jpeg": ".jpg", "image/png": ".png", "application/zip": ".zip",
}


def query_field(url: Column, name: str) -> Column:
    return filled(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def session_id(url: Column) -> Column:
    """The id in an address's query, else the address."""
    return F.coalesce(*[query_field(url, f) for f in SESSION_FIELDS], url)


def stable_id(session: Column, url: Column, agenda: Column) -> Column:
    """The first 64 bits of the md5 of the three parts, as decimal(20,0): the same document has it in every build."""
    key = F.concat_ws("|", as_text(session), as_text(url), as_text(agenda))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def is_document_link(href: Column) -> Column:
    low = F.lower(as_text(href))
    return F.contains(low, F.lit("type=do")) | F.contains(low, F.lit("getfile.asp"))


def absolute(base: str, href: Column) -> Column:
    """A relative address below a base that ends in a slash; absolute ones stay."""
    root = "/".join(base.split("/")[:3])
    return F.when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(base), href))


def content_length(value: Column) -> Column:
    n = F.btrim(value).try_cast("long")
    return F.when(n >= 0, n)


def header_value(value: Column) -> Column:
    return filled(F.btrim(value))


def disposition_name(value: Column) -> Column:
    """The file name of a content-disposition header; the encoded form comes first."""
    coded = F.try_url_decode(F.replace(F.regexp_extract(value, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1), F.lit("+"), F.lit("%2B")))
    quoted = F.regexp_extract(value, r'(?i)filename\s*=\s*"([^"]*)"', 1)
    bare = F.regexp_extract(value, r"(?i)filename\s*=\s*([^;\"]+)", 1)
    return F.coalesce(filled(F.btrim(coded)), filled(F.btrim(quoted)), filled(F.btrim(bare)))


def suffix(path: Column) -> Column:
    """The extension of a path in lower case, with its dot; null if it has none."""
    return filled(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8})$", 1)))


def extension(content_type: Column, disposition: Column, url: Column, title: Column) -> Column:
    """By media type, then by the header's file name, then by the address (no .asp), then by a title with pdf."""
    mime = F.lower(F.btrim(F.split_part(as_text(content_type), F.lit(";"), F.lit(1))))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    path = suffix(F.try_parse_url(url, F.lit("PATH")))
    return F.coalesce(
        F.try_element_at(known, mime),
        suffix(disposition_name(disposition)),
        F.when(~F.startswith(path, F.lit(".asp")), path),
        F.when(F.contains(F.lower(as_text(title)), F.lit("pdf")), F.lit(".pdf")),
        F.lit(".bin"),
    )


def unchanged(old_etag: Column, etag: Column, old_modified: Column, modified: Column, old_length: Column, length: Column) -> Column:
    """Whether headers say that a stored document is still current: equal ETags decide if both are there, else an equal
    date of change with an equal length where both are known. Without headers: changed."""
    tags = old_etag.isNotNull() & etag.isNotNull()
    dates = old_modified.isNotNull() & modified.isNotNull()
    sizes = F.when(old_length.isNotNull() & length.isNotNull(), old_length == length).otherwise(F.lit(True))
    return F.when(tags, old_etag == etag).when(dates, (old_modified == modified) & sizes).otherwise(F.lit(False))
