"""Dates as ISO text and in the German form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The forms of a day on the portal's pages: d.m.yyyy, d.m. before something else than a year, and d or d.
_N = r"(\d{1,2})"
FULL, SHORT, DAY = rf"\b{_N}\.{_N}\.(\d{{2,4}})\b", rf"\b{_N}\.{_N}\.(?!\d)", rf"\b{_N}\.?\b"


def day_value(text: Column, year: Column, month: Column) -> Column:
    """The date that a day cell names: d.m.yyyy (or yy: 20yy), else d.m. in the page's year, else a day of its month.

    A full date that doesn't exist gives null; it is not read again as a day.
    """
    t = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    part = lambda p, i: F.regexp_extract(t, p, i)
    y = part(FULL, 3)
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(F.lpad(y, 4, "0"))
    date = lambda d, m, y: F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
    ys, ms = year.cast("string"), month.cast("string")
    return (
        F.when(F.rlike(t, F.lit(FULL)), date(part(FULL, 1), part(FULL, 2), y))
        .when(F.rlike(t, F.lit(SHORT)), date(part(SHORT, 1), part(SHORT, 2), ys))
        .when(F.rlike(t, F.lit(DAY)), date(part(DAY, 1), ms, ys))
    )


def german(iso: Column) -> Column:
    """dd.MM.yyyy of an ISO date or timestamp; other text unchanged, null as the empty string."""
    v = F.coalesce(iso.cast("string"), F.lit(""))
    return F.coalesce(F.date_format(F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")), "dd.MM.yyyy"), v)


def year_month(iso: Column) -> tuple[Column, Column]:
    """Year and month of ISO text as integers; null where they aren't numbers."""
    at = lambda i: F.split_part(iso, F.lit("-"), F.lit(i)).try_cast("int")
    return at(1), at(2)


def utc_text(ts: Column, micros: bool = False) -> Column:
    """A timestamp as ISO text in UTC, ending in Z (the session's time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if micros else "") + "'Z'")


def session_status(date: Column, today: str) -> Column:
    """vergangen, heute or kommend by text order; a null date counts as kommend."""
    return F.when(date < today, "vergangen").when(date == today, "heute").otherwise("kommend")


def session_state(date: Column, today: str) -> Column:
    """The same in words of a report, for dates that may be missing or unreadable."""
    d = F.to_date(F.try_to_timestamp(F.substring(F.coalesce(date, F.lit("")), 1, 10), F.lit("yyyy-MM-dd")))
    t = F.lit(today).cast("date")
    return F.when(F.coalesce(date, F.lit("")) == "", "Datum unbekannt").when(d.isNull(), "Datum nicht auswertbar").when(d < t, "vergangene Sitzung").when(d == t, "heutige Sitzung").otherwise("zukünftige Sitzung")


def preset(name: str, today: dt.date) -> tuple[str, str]:
    """First and last day of a named range."""
    days = {"Heute": (0, 0), "Naechste 30 Tage": (0, 30), "Letzte 30 Tage": (-30, 0)}
    if name == "Dieses Jahr":
        return f"{today.year}-01-01", f"{today.year}-12-31"
    a, b = days[name]
    return (today + dt.timedelta(a)).isoformat(), (today + dt.timedelta(b)).isoformat()


def check_month(year: int, months: list[int] | None = None) -> list[int]:
    """The months to visit; ValueError outside 2000 to 2100 or 1 to 12."""
    if not 2000 <= year <= 2100 or any(not 1 <= m <= 12 for m in months or ()):
        raise ValueError("year or month out of range")
    return months or list(range(1, 13))
