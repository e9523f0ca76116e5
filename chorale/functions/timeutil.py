"""Local time from epoch seconds, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Vancouver"


def local(ts: Column, zone: str = ZONE) -> Column:
    """Epoch seconds -> local wall-clock time (no zone)."""
    utc = F.timestamp_add("SECOND", ts, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def ymd(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def ym(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM")


def hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(local(ts, zone))


def weekday_sunday0(ts: Column, zone: str = ZONE) -> Column:
    return F.dayofweek(local(ts, zone)) - 1


def weekday_monday0(ts: Column, zone: str = ZONE) -> Column:
    return F.weekday(local(ts, zone))


def week_key(ts: Column, zone: str = ZONE) -> Column:
    """The Monday of the local week, as a date string."""
    return F.date_format(F.date_trunc("WEEK", local(ts, zone)), "yyyy-MM-dd")


def epoch(ts: Column) -> Column:
    """A zone-less timestamp read as UTC -> epoch seconds."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def daypart(h: Column) -> Column:
    return F.when((h >= 5) & (h < 11), "morning").when((h >= 11) & (h < 17), "afternoon").when((h >= 17) & (h < 22), "evening").otherwise("night")
