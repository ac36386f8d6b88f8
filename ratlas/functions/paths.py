"""Paths of stored files: lexical resolution, the raw root, the older layout without months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratlas.functions.text import as_text, filled

#: Fixed value: the folder below which all raw data lies.
RAW_ROOT = "data/raw"
_NONE = "cast(array() as array<string>)"


def forward(path: Column) -> Column:
    """Trimmed, with forward slashes; blank and null as null."""
    return filled(F.btrim(F.replace(as_text(path), F.lit("\\"), F.lit("/"))))


def resolve(path: Column) -> Column:
    """A path without '.', '..' and doubled slashes; '..' above the start is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.expr(_NONE), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def raw_root(path: Column) -> Column:
    """The part of a path up to its first data/raw; null if it has none."""
    return filled(F.regexp_extract(path, r"^(.*?(?:^|/)data/raw)(?:/|$)", 1))


def inside(path: Column, root: Column) -> Column:
    return F.coalesce((path == root) | F.startswith(path, F.concat(root, F.lit("/"))), F.lit(False))


def upgraded(path: Column) -> Column:
    """A session path of the older layout with the month of its folder's name between; current ones as they are; null if
    no month can be told."""
    month = F.coalesce(filled(F.regexp_extract(path, r"/\d{4}/\d{4}-(\d{2})-\d{2}[-_][^/]+$", 1)), filled(F.regexp_extract(path, r"/\d{4}/\d{4}-(\d{2})_overview\.html$", 1)))
    return F.when(F.rlike(path, F.lit(r"/\d{2}/[^/]+$")), path).when(month.isNotNull(), F.concat(F.regexp_extract(path, r"^(.*/)[^/]+$", 1), month, F.lit("/"), F.regexp_extract(path, r"([^/]+)$", 1)))


def candidates(session_path: Column, local_path: Column, root: str = RAW_ROOT) -> Column:
    """Where a document's file may lie, in the order in which to try: below its session, then below the session's path in
    the current layout; an absolute path only itself. Paths that leave the raw root are left out."""
    local, base = forward(local_path), resolve(forward(session_path))
    own = F.filter(F.array(F.lit(root), raw_root(base)), lambda r: r.isNotNull())
    within = lambda p: F.exists(own, lambda r: inside(p, r))
    tried = F.when(F.startswith(local, F.lit("/")), F.array(resolve(local))).otherwise(F.array(resolve(F.concat_ws("/", base, local)), resolve(F.concat_ws("/", upgraded(base), local))))
    usable = local.isNotNull() & (F.startswith(local, F.lit("/")) | base.isNotNull())
    return F.when(usable, F.array_distinct(F.filter(tried, lambda p: p.isNotNull() & within(p)))).otherwise(F.expr(_NONE))


def output_folder(session_path: Column, date: Column, created_at: Column, session_id: Column) -> Column:
    """YYYY/MM/folder as in the session's path, else by date and session."""
    own = F.regexp_extract(F.replace(as_text(session_path), F.lit("\\"), F.lit("/")), r"(?:^|/)(\d+/\d+/[^/]+)/?$", 1)
    day = F.coalesce(filled(date), F.substring(as_text(created_at), 1, 10))
    return F.coalesce(filled(own), F.concat(F.substring(day, 1, 4), F.lit("/"), F.substring(day, 6, 2), F.lit("/"), F.concat_ws("-", day, filled(session_id))))
