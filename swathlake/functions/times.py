"""UTC seconds, year days and the 1980 epoch with leap seconds, as column expressions. Seconds are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of 1980-01-06 00:00 UTC in the 1970 epoch.
GPS_EPOCH = 315964800
#: Seconds of 1980-01-01 00:00 UTC in the 1970 epoch.
EPOCH_1980 = 315532800
#: Days after whose end a leap second was added, from 1981 on.
LEAP_DAYS = ("1981-06-30", "1982-06-30", "1983-06-30", "1985-06-30", "1987-12-31", "1989-12-31", "1990-12-31", "1992-06-30", "1993-06-30", "1994-06-30", "1995-12-31", "1997-06-30", "1998-12-31", "2005-12-31", "2008-12-31", "2012-06-30", "2015-06-30", "2016-12-31")


def day_start(year: Column, day: Column) -> Column:
    """Date of a year and day of the year, from 1."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def seconds_of_date(d: Column) -> Column:
    return (F.unix_date(d).cast("long") * 86400).cast("double")


def year_day_to_utc(year: Column, day: Column, h: Column, m: Column, s: Column) -> Column:
    return seconds_of_date(day_start(year, day)) + h * 3600.0 + m * 60.0 + s


def calendar_to_utc(year: Column, month: Column, day: Column, h: Column, m: Column, s: Column) -> Column:
    return seconds_of_date(F.make_date(year, month, day)) + h * 3600.0 + m * 60.0 + s


def clock(seconds: Column) -> Column:
    """(h, m, s, ms) of seconds of a day."""
    s = F.floor(seconds)
    return F.struct((s / 3600).cast("int").alias("h"), F.pmod(F.floor(s / 60), F.lit(60)).cast("int").alias("m"), F.pmod(s, F.lit(60)).cast("int").alias("s"), F.bround((seconds - s) * 1000).cast("int").alias("ms"))


def clock_seconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return h * 3600.0 + m * 60.0 + s + ms / 1000.0


def leap_seconds(utc: Column) -> Column:
    """Leap seconds added between 1980 and a time."""
    return F.size(F.filter(F.array(*[seconds_of_date(F.lit(d).cast("date")) + 86400.0 for d in LEAP_DAYS]), lambda t: t <= utc)).cast("double")


def year_day_to_1980(year: Column, day: Column, seconds: Column) -> Column:
    """Seconds since 1980 with leap seconds counted."""
    utc = seconds_of_date(day_start(year, day)) + seconds
    return utc - float(EPOCH_1980) + leap_seconds(utc)


def from_1980(t: Column) -> Column:
    """UTC seconds of seconds since 1980 with leap seconds counted; a leap second itself is the next day's first."""
    # the k-th leap second ends at its day's end, k seconds later on this clock
    ends = F.array(*[seconds_of_date(F.lit(d).cast("date")) + float(86400 - EPOCH_1980 + k + 1) for k, d in enumerate(LEAP_DAYS)])
    return t - F.size(F.filter(ends, lambda e: e <= t)).cast("double") + float(EPOCH_1980)


def gps_week_seconds(utc: Column) -> Column:
    return F.pmod(utc - float(GPS_EPOCH), F.lit(604800.0))


def month_and_day(year: Column, day: Column) -> Column:
    """(month, day) of a day of the year."""
    d = day_start(year, day)
    return F.struct(F.month(d).alias("month"), F.dayofmonth(d).alias("day"))


def day_of_year(year: Column, month: Column, day: Column) -> Column:
    return F.dayofyear(F.make_date(year, month, day))


def year_day_difference(y1: Column, d1: Column, s1: Column, y2: Column, d2: Column, s2: Column) -> Column:
    """Seconds of the first year, day and seconds less those of the second."""
    return seconds_of_date(day_start(y1, d1)) - seconds_of_date(day_start(y2, d2)) + s1 - s2


def year_day_plus(year: Column, day: Column, seconds: Column, more: Column) -> Column:
    """(year, day, seconds) some seconds later."""
    t = seconds_of_date(day_start(year, day)) + seconds + more
    d = F.date_from_unix_date(F.floor(t / 86400).cast("int"))
    return F.struct(F.year(d).alias("year"), F.dayofyear(d).alias("day"), (t - seconds_of_date(d)).alias("seconds"))


def to_1980(utc: Column) -> Column:
    """Seconds since 1980, with leap seconds counted, of UTC seconds."""
    return utc - float(EPOCH_1980) + leap_seconds(utc)


def elapsed_text(seconds: Column) -> Column:
    """A duration as hours, minutes and seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d hours, %d minutes, %d seconds", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))
