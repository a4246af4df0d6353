"""Dates, times and durations, Column -> Column; sessions run in UTC."""

from __future__ import annotations

import datetime as dt
import functools
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours and minutes from UTC of zone abbreviations.
ZONE_OFFSETS = {
    "UTC": (0, 0), "GMT": (0, 0), "Z": (0, 0),
    "EST": (-5, 0), "EDT": (-4, 0), "CST": (-6, 0), "CDT": (-5, 0),
    "MST": (-7, 0), "MDT": (-6, 0), "PST": (-8, 0), "PDT": (-7, 0),
    "AKST": (-9, 0), "AKDT": (-8, 0), "HST": (-10, 0),
    "AST": (-4, 0), "ADT": (-3, 0), "NST": (-3, -30), "NDT": (-2, -30),
    "BST": (1, 0), "IST": (5, 30), "CET": (1, 0), "CEST": (2, 0),
    "EET": (2, 0), "EEST": (3, 0), "WET": (0, 0), "WEST": (1, 0),
    "AEST": (10, 0), "AEDT": (11, 0), "ACST": (9, 30), "ACDT": (10, 30),
    "AWST": (8, 0), "NZST": (12, 0), "NZDT": (13, 0), "JST": (9, 0),
    "KST": (9, 0), "SGT": (8, 0), "HKT": (8, 0), "SAST": (2, 0),
}
CORE_DATA_EPOCH = 978307200


def meeting_date(c: Column) -> Column:
    """ISO date and time, date, or US date with a 12-hour clock; else an ISO prefix."""
    shapes = [F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy hh:mm a")]
    return F.coalesce(*shapes, F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def iso_utc(c: Column) -> Column:
    """An ISO 8601 time, its offset applied, without fractions."""
    return F.date_trunc("second", F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.regexp_replace(c, r"\.\d+", ""))))


def without_offset(c: Column) -> Column:
    """An ISO 8601 time as text, its offset dropped and not applied."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("T"), F.lit(" ")), r"\.\d+", ""), r"\s*(Z|[+-]\d{2}:?\d{2})$", "")


@functools.cache
def known_zone(zone: str) -> bool:
    try:
        return bool(ZoneInfo(zone))
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return False


def to_local(c: Column, zone: str) -> Column:
    """Null where the zone is unknown."""
    return F.from_utc_timestamp(c, zone) if known_zone(zone) else F.lit(None).cast("timestamp")


def to_utc(c: Column, zone: str) -> Column:
    """Null where the zone is unknown."""
    return F.to_utc_timestamp(c, zone) if known_zone(zone) else F.lit(None).cast("timestamp")


def zone_minutes(local: Column, zone: str) -> Column:
    """Minutes that a local time of the zone is ahead of UTC."""
    return ((F.unix_timestamp(local) - F.unix_timestamp(to_utc(local, zone))) / 60).cast("int")


def offset_minutes(abbreviation: Column, local: Column, zone: str) -> Column:
    """Minutes ahead of UTC by an abbreviation; one that isn't known gives way to the zone."""
    table = F.create_map(*[F.lit(x) for k, (h, m) in ZONE_OFFSETS.items() for x in (k, 60 * h + m)])
    return F.coalesce(F.try_element_at(table, F.upper(abbreviation)), zone_minutes(local, zone))


def zone_abbreviation(utc: Column, zone: str) -> Column:
    """The first abbreviation of the table that fits the zone at that time, of its own country's
    winter and summer names where it has some; else the offset as +hh:mm; null for an unknown zone."""
    if not known_zone(zone):
        return F.lit(None).cast("string")
    names = {}
    for month in (1, 7):
        at = dt.datetime(2024, month, 1, 12, tzinfo=ZoneInfo(zone))
        names[int(at.utcoffset().total_seconds() // 60)] = at.tzname()
    minutes = zone_minutes(to_local(utc, zone), zone)
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    plain = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))
    return F.coalesce(F.try_element_at(known, minutes), plain)


def clock_seconds(c: Column) -> Column:
    """h:m:s, m:s or s, aligned to the right; parts before the hours don't count."""
    parts = F.split(c, ":")
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    return F.aggregate(last, F.lit(0).cast("long"), lambda a, x: a * 60 + F.coalesce(x.try_cast("long"), F.lit(0)))


def offset_text(seconds: Column) -> Column:
    """hh:mm:ss."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def minutes_text(seconds: Column) -> Column:
    """mm:ss; minutes may exceed 59."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def duration(minutes: Column) -> Column:
    """75 -> 1h 15m, 60 -> 1h 00m, 15 -> 15m; nothing for none."""
    m = F.floor(minutes)
    return F.when(m <= 0, F.lit("")).when(m < 60, F.format_string("%dm", m)).otherwise(F.format_string("%dh %02dm", F.floor(m / 60), m % 60))


def meeting_duration(seconds: Column, most_hours: int = 24) -> Column:
    """Hours and minutes of a meeting; nothing below a minute or for a span too long to be one."""
    return F.when((seconds < 0) | (seconds > most_hours * 3600), F.lit("")).otherwise(duration(F.floor(seconds / 60)))


def any_epoch(c: Column) -> Column:
    """A time as milliseconds since 1970 or as ISO text, in UTC without fractions; a date alone
    stays a date. As text."""
    number = c.try_cast("long")
    at = F.coalesce(F.timestamp_millis(number), iso_utc(c))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).otherwise(F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def legacy_utc(c: Column, zone: str) -> Column:
    """A time written as UTC text, as local text of the zone; other text stays."""
    at = F.try_to_timestamp(F.regexp_replace(c, r"\s*(UTC|Z)$", ""))
    return F.coalesce(F.date_format(to_local(at, zone), "yyyy-MM-dd HH:mm:ss"), c)


def short_duration(seconds: Column) -> Column:
    """45.0s below two minutes, else 2m 5s; a dash for none."""
    long = F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds) % 60)
    return F.when(seconds.isNull(), "—").when(seconds < 120, F.format_string("%.1fs", seconds.cast("double"))).otherwise(long)


def core_data(c: Column) -> Column:
    return F.timestamp_seconds(c + CORE_DATA_EPOCH)


def apple_date(c: Column) -> Column:
    """Friday, March 1, 2024 at 10:00:00: the weekday goes before parsing."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^\w+,\s*", ""), F.lit("MMMM d, yyyy 'at' HH:mm:ss"))


def iso_week(c: Column) -> Column:
    """2024-W07."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.extract(F.lit("WEEK"), c))


def monday(c: Column) -> Column:
    return F.to_date(F.date_trunc("week", c))


def window_start(today: str, days: int) -> Column:
    """The first day of the last so many days; there is no upper bound."""
    return F.date_sub(F.lit(today).cast("date"), days)


def first_date(*columns: Column) -> Column:
    """The first of several texts whose first ten characters are a date."""
    return F.coalesce(*[F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date") for c in columns])
