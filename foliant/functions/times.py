"""Moments as text, and the gates of what runs by the clock. A moment is always a column, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of moments in records, in names of backups, and of days; fixed values.
ISO, STAMP, DAY = "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd_HHmmss", "yyyy-MM-dd"
#: What runs by the clock: name, hour, day of the week (1 is Sunday) or day of the month if it is tied to one; fixed values.
SCHEDULE = (("daily_cleanup", 2, None, None), ("weekly_cleanup", 3, 1, None), ("monthly_cleanup", 4, None, 1))


def iso(at: Column) -> Column:
    return F.date_format(at, ISO)


def stamp(at: Column) -> Column:
    return F.date_format(at, STAMP)


def day(at: Column) -> Column:
    return F.date_format(at, DAY)


def iso_of_epoch(seconds: Column) -> Column:
    return iso(F.timestamp_seconds(seconds))


def age_hours(at: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600


def older_than(at: Column, as_of: Column, days: Column) -> Column:
    """Whether more whole days have passed than the given ones."""
    return F.floor(age_hours(at, as_of) / 24) > days


def due(at: Column, schedule: tuple = SCHEDULE) -> Column:
    """The names of what runs in the hour of a moment."""
    hits = []
    for name, hour, weekday, monthday in schedule:
        hit = F.hour(at) == hour
        if weekday is not None:
            hit = hit & (F.dayofweek(at) == weekday)
        if monthday is not None:
            hit = hit & (F.dayofmonth(at) == monthday)
        hits.append(F.when(hit, name))
    return F.array_compact(F.array(*hits))
