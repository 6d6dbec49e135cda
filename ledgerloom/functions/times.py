"""Times, days and calendar labels (FN-7..15, FN-36, ING-12, RPT-20)."""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """'YYYY-MM-DD' of an instant in a zone; the session's zone is UTC (ING-12)."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def weekday(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEEE"), F.lit("unknown"))


def hour(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH"), F.lit("unknown"))


def month(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def instant_key(text: Column) -> Column:
    """UTC second and nine digits of fraction: text order is time order; '' if unreadable (FN-12)."""
    at = F.try_to_timestamp(text)
    digits = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0")
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), digits, F.lit("Z")), F.lit(""))


def month_name(day: Column) -> Column:
    return F.date_format(F.to_date(day), "MMMM")


def span_label(first: Column, last: Column) -> Column:
    """'Jan 02 2006 to Jan 05 2006', one day: once (FN-8)."""
    a, b = F.date_format(first, "MMM dd yyyy"), F.date_format(last, "MMM dd yyyy")
    return F.when(first == last, a).otherwise(F.concat(a, F.lit(" to "), b))


def day_spine(bounds: DataFrame, first: str = "first", last: str = "last", name: str = "date") -> DataFrame:
    """Every day from first to last of a one-row table, as text (FN-14)."""
    days = F.explode(F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day")))
    return bounds.select(days.alias("_d")).select(F.date_format("_d", "yyyy-MM-dd").alias(name))


def rolling_year(today: date) -> tuple[date, date]:
    """(first, last): a year back and a day on; 29 February falls to 1 March (FN-15)."""
    try:
        back = today.replace(year=today.year - 1)
    except ValueError:
        back = date(today.year - 1, 3, 1)
    return back + timedelta(days=1), today


def zone_fingerprint(zone: str) -> str:
    """Hash of the zone's offsets day by day from 1970 to 2100 (FN-36)."""
    tz, digest = ZoneInfo(zone), hashlib.sha256()
    at, end = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
    while at < end:
        digest.update(str(int(at.astimezone(tz).utcoffset().total_seconds())).encode() + b";")
        at += timedelta(days=1)
    return digest.hexdigest()


def window_in_zone(zone: str, year: int | None = None, month_: int | None = None, day: int | None = None) -> tuple[datetime | None, datetime | None]:
    """[since, until) as UTC instants of a year, month or day in a zone (FLT-22)."""
    if year is None:
        return None, None
    tz = ZoneInfo(zone)
    since = datetime(year, month_ or 1, day or 1, tzinfo=tz)
    if day:
        until = datetime.combine(since.date() + timedelta(days=1), datetime.min.time(), tz)
    elif month_:
        until = datetime(year + month_ // 12, month_ % 12 + 1, 1, tzinfo=tz)
    else:
        until = datetime(year + 1, 1, 1, tzinfo=tz)
    return since.astimezone(timezone.utc), until.astimezone(timezone.utc)
