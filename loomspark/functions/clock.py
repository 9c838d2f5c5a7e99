"""Time expressions. "Now" is always an argument; weekdays start on Monday with 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the day and the hour at which each ends.
PARTS_OF_DAY = ((5, "the small hours"), (8, "early morning"), (12, "morning"), (14, "midday"), (18, "afternoon"), (22, "evening"), (24, "night"))
# What the days of a week are called, Monday first.
DAY_WORDS = ("the start of the work week", "midweek", "midweek", "midweek", "the end of the work week", "the weekend", "the weekend")
# Seasons of the northern half by month.
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
OPPOSITE = {"winter": "summer", "summer": "winter", "spring": "autumn", "autumn": "spring"}
# Names of weekdays and of small numbers.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HOUR_WORDS = ("twelve", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven")
DATE_REF = r"^(today|tomorrow|weekday:(monday|tuesday|wednesday|thursday|friday|saturday|sunday):(this|next)|relative:\+\d{1,3})$"


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double; the session's time zone should be UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def parse_time(text: Column) -> Column:
    """Epoch seconds of ISO or mail-style times, or null. Fractions and zone offsets count; without a zone it is UTC."""
    text = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")), F.try_to_timestamp(plain))
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, | ?(GMT|UTC|Z|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    zone = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    part = lambda i: F.coalesce(F.regexp_extract(zone, r"(\d{2}):?(\d{2})$", i).try_cast("int"), F.lit(0))
    ahead = F.when(F.rlike(text, F.lit(r":\d{2}(\.\d+)? ?[+-]\d{2}:?\d{2}$")), sign * (part(1) * 3600 + part(2) * 60)).otherwise(0)
    return epoch(F.coalesce(iso, mail)) - ahead


def part_of_day(hour: Column) -> Column:
    ends, names = zip(*PARTS_OF_DAY)
    passed = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= hour))
    return F.element_at(F.array(*map(F.lit, names)), passed + 1)


def day_descriptor(day: Column) -> Column:
    """What a weekday (Monday 0) is called."""
    return F.element_at(F.array(*map(F.lit, DAY_WORDS)), day + 1)


def season(month: Column, south: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), OPPOSITE[name] if south else name).otherwise(out)
    return out


def in_minutes(ts: Column, start: int, end: int) -> Column:
    """Whether the minute of the day is in [start, end), around midnight if start is later than end."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def half_life(age: Column, half: float) -> Column:
    """0.5 to the power age / half."""
    return F.pow(F.lit(0.5), age / F.lit(float(half)))


def relative_time(seconds: Column) -> Column:
    """An age in words: now, minutes, hours, days."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d ago")))
    )


def resolve_date(ref: Column, today: Column) -> Column:
    """The date that today, tomorrow, weekday:NAME:this|next or relative:+N stands for; null for anything else."""
    name = F.regexp_extract(ref, r"^weekday:([a-z]+):", 1)
    place = F.array_position(F.array(*map(F.lit, WEEKDAYS)), name).cast("int") - 1
    ahead = F.pmod(place - F.weekday(today), F.lit(7)) + F.when(ref.endswith(":next"), 7).otherwise(0)
    return (
        F.when(~F.rlike(ref, F.lit(DATE_REF)), None)
        .when(ref == "today", today)
        .when(ref == "tomorrow", F.date_add(today, 1))
        .when(ref.startswith("weekday:"), F.date_add(today, ahead))
        .otherwise(F.date_add(today, F.expr("0") + F.coalesce(F.regexp_extract(ref, r"\+(\d+)", 1).try_cast("int"), F.lit(0))))
    )


def spoken_time(ts: Column) -> Column:
    """The hour in words with quarter marks: 'quarter past three', 'half past', 'quarter to', or o'clock at the nearest quarter."""
    quarter = F.floor((F.hour(ts) * 60 + F.minute(ts) + 7) / 15).cast("int")
    names = F.array(*map(F.lit, HOUR_WORDS))
    hour, next_hour = F.floor(quarter / 4) % 12, (F.floor(quarter / 4) + 1) % 12
    word, after = F.element_at(names, hour.cast("int") + 1), F.element_at(names, next_hour.cast("int") + 1)
    part = quarter % 4
    return (
        F.when(part == 0, F.concat(word, F.lit(" o'clock")))
        .when(part == 1, F.concat(F.lit("quarter past "), word))
        .when(part == 2, F.concat(F.lit("half past "), word))
        .otherwise(F.concat(F.lit("quarter to "), after))
    )


def spoken_range(start: Column, end: Column) -> Column:
    """Two times in words: 'from two o'clock to half past three'; one of them where they sound alike."""
    a, b = spoken_time(start), spoken_time(end)
    return F.when(a == b, a).otherwise(F.concat(F.lit("from "), a, F.lit(" to "), b))
