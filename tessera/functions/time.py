"""Times and days: all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names of mail-style dates.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse(x: Column) -> Column:
    """Timestamp of an ISO 8601 text, of "Fri Jul 11 08:00:00 +0000 2026" or of "Fri, 11 Jul 2026 08:00:00 +0000"; null for others.

    Texts without an offset are UTC (the session's zone is).
    """
    month = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("string"), 2, "0")
    social, mail = r"^\w{3} (\w{3}) (\d{1,2}) (\d\d:\d\d:\d\d) ([+-]\d{4}) (\d{4})$", r"^(?:\w{3}, )?(\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d) (?:([+-]\d{4})|GMT|UTC)$"
    part = lambda p, i: F.regexp_extract(x, p, i)
    zone = lambda z: F.when(z == "", F.lit("+00:00")).otherwise(F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2)))
    day = lambda y, m, d, t, z: F.concat(y, F.lit("-"), month(m), F.lit("-"), F.lpad(d, 2, "0"), F.lit("T"), t, zone(z))
    iso = F.when(x.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), x)
    made = F.when(x.rlike(social), day(part(social, 5), part(social, 1), part(social, 2), part(social, 3), part(social, 4))).when(
        x.rlike(mail), day(part(mail, 3), part(mail, 2), part(mail, 1), part(mail, 4), part(mail, 5))
    )
    return F.coalesce(iso, made).try_cast("timestamp")


def iso(x: Column) -> Column:
    """2026-07-11T08:00:00+00:00 of a timestamp."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def days(start: Column, end: Column) -> Column:
    """All days from start to end, both included; empty if end is before start."""
    return F.when(end >= start, F.sequence(F.to_date(start), F.to_date(end))).otherwise(F.array().cast("array<date>"))


def in_window(ts: Column, start, end) -> Column:
    """Whether the day of ts lies from start to end; false where ts is null."""
    return F.coalesce(F.to_date(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


def is_current(published: Column, day: Column, most: int = 7) -> Column:
    """Published no more than ``most`` days before the day, and not after it."""
    return F.coalesce(F.datediff(F.to_date(day), F.to_date(published)).between(0, most), F.lit(False))


def display_day(x: Column) -> Column:
    """11 July 2026."""
    return F.date_format(x, "d MMMM yyyy")
