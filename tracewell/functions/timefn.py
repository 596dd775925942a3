"""Local time as integer arithmetic on epoch seconds, so no session zone takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds east of UTC.
OFFSET = 19_800
DAYS = ("Thursday", "Friday", "Saturday", "Sunday", "Monday", "Tuesday", "Wednesday")
#: First hours of morning, afternoon, evening and night; outside them it is night, in the last variant morning.
HOURS = {"visit": (6, 12, 17, 21), "trip": (6, 12, 18, 22), "ping": (5, 12, 17, 21), "plain": (0, 12, 17, 21)}


def local(ts: Column, offset: int = OFFSET) -> Column:
    return ts + F.lit(offset)


def minute_of_day(ts: Column, offset: int = OFFSET) -> Column:
    return F.floor(F.pmod(local(ts, offset), F.lit(86_400)) / 60).cast("int")


def hour(ts: Column, offset: int = OFFSET) -> Column:
    return F.floor(F.pmod(local(ts, offset), F.lit(86_400)) / 3600).cast("int")


def day_number(ts: Column, offset: int = OFFSET) -> Column:
    return F.floor(local(ts, offset) / 86_400).cast("int")


def date_text(ts: Column, offset: int = OFFSET) -> Column:
    return F.date_format(F.date_from_unix_date(day_number(ts, offset)), "yyyy-MM-dd")


def day_of_week(ts: Column, offset: int = OFFSET) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.pmod(day_number(ts, offset), F.lit(7)) + 1)


def is_weekend(ts: Column, offset: int = OFFSET) -> Column:
    return F.pmod(day_number(ts, offset), F.lit(7)).isin(2, 3)


def time_of_day(h: Column, variant: str) -> Column:
    """morning, afternoon, evening or night of an hour; the four variants differ in where these begin."""
    morning, afternoon, evening, night = HOURS[variant]
    return F.when((h >= morning) & (h < afternoon), "morning").when((h >= afternoon) & (h < evening), "afternoon").when((h >= evening) & (h < night), "evening").otherwise("night")


def parse_minutes(text: Column) -> Column:
    """Minutes of "HH:mm" (checked range) or "h:mmAM" (any numbers); null for anything else."""
    t = F.upper(F.trim(text))
    h24, m24 = (F.regexp_extract(t, r"^([0-9]{1,2}):([0-9]{2})$", k).try_cast("int") for k in (1, 2))
    h12, m12 = (F.regexp_extract(t, r"^([0-9]{1,2}):([0-9]{2})\s*(AM|PM)$", k).try_cast("int") for k in (1, 2))
    half = F.regexp_extract(t, r"^([0-9]{1,2}):([0-9]{2})\s*(AM|PM)$", 3)
    return F.when(h24.isNotNull(), F.when((h24 <= 23) & (m24 <= 59), h24 * 60 + m24)).when(half != "", h12 % 12 * 60 + m12 + F.when(half == "PM", 720).otherwise(0))


def format_minutes(m: Column, end_of_day: bool = False) -> Column:
    """HH:MM of a minute of the day; 1440 is 24:00 where end_of_day is set, else it wraps."""
    w = F.pmod(m, F.lit(1440))
    text = F.concat(F.lpad(F.floor(w / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((w % 60).cast("string"), 2, "0"))
    return F.when(m == 1440, "24:00").otherwise(text) if end_of_day else text


def format_clock(ts: Column, offset: int = OFFSET) -> Column:
    """9:05AM of epoch seconds."""
    h = hour(ts, offset)
    return F.concat(F.when(h % 12 == 0, "12").otherwise((h % 12).cast("string")), F.lit(":"), F.lpad((minute_of_day(ts, offset) % 60).cast("string"), 2, "0"), F.when(h < 12, "AM").otherwise("PM"))


def format_duration(sec: Column) -> Column:
    """2h 5m, 2h, 5m or 9s."""
    h, m = F.floor(sec / 3600), F.floor(sec % 3600 / 60)
    text = lambda v, unit: F.concat(v.cast("string"), F.lit(unit))
    return F.when((h > 0) & (m > 0), F.concat_ws(" ", text(h, "h"), text(m, "m"))).when(h > 0, text(h, "h")).when(m > 0, text(m, "m")).otherwise(text(F.floor(sec).cast("long"), "s"))


def format_confidence(value: Column) -> Column:
    """Shares up to 1 as percentages, rounded half up."""
    v = F.when(value <= 1, value * 100).otherwise(value)
    return F.concat(F.floor(v + 0.5).cast("long").cast("string"), F.lit("%"))
