"""Calendar and clock expressions; every 'now' is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(text: Column) -> Column:
    """The date of a 'YYYY-MM-DD' text, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def clock(text: Column) -> Column:
    """The 'HH:MM' at the start of a text, else null."""
    head = F.substring(text, 1, 5)
    return F.when(head.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), head)


def instant(day: Column, time: Column, offset: str = "+07:00") -> Column:
    """The UTC instant of a local date and clock time."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), time, F.lit(":00"))), offset)


def occurrence_id(given: Column, plan: Column, at: Column, offset: str = "+07:00") -> Column:
    """The given id (trimmed, cut to 120), else plan, local date and clock time."""
    local = F.from_utc_timestamp(at, offset)
    own = F.concat_ws(":", plan, F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm"))
    return F.coalesce(F.nullif(F.substring(F.trim(given), 1, 120), F.lit("")), own)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000


def effective_status(status: Column, scheduled: Column, now: Column, miss_after: int = 45) -> Column:
    """Pending turns missed once more than ``miss_after`` minutes have passed."""
    return F.when((status == "pending") & (minutes_between(scheduled, now) > miss_after), "missed").otherwise(status)


def due(scheduled: Column, now: Column, miss_after: int = 45) -> Column:
    return minutes_between(scheduled, now).between(0, miss_after)


def soon(scheduled: Column, now: Column, lead: int = 30) -> Column:
    return F.floor(minutes_between(now, scheduled)).between(0, lead)


def week_start(day: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def day_period(at: Column) -> Column:
    hour = F.hour(at)
    return F.when(hour.between(5, 10), "morning").when(hour.between(11, 13), "noon").when(hour.between(14, 17), "afternoon").otherwise("evening")


def resolved_end(start: Column, end: Column, days: Column, default_days: int = 1) -> Column:
    """The end date, else the start and as many days."""
    span = F.greatest(F.coalesce(days, F.lit(default_days)), F.lit(1))
    return F.coalesce(end, F.date_add(start, (span - 1).cast("int")))


def overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The common part of two date ranges; null where there is none."""
    first, last = F.greatest(start, low), F.least(end, high)
    return F.when(first <= last, F.struct(first.alias("first"), last.alias("last")))


def span_text(text: Column) -> Column:
    """Seconds of a span such as '7d', '12h', '30m' or '45s'."""
    size = F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 2)
    return size * F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
