"""Calendar files as rows: entries out of iCalendar text, and the occurrences of their recurrence rules in a window."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import _written

#: Weekdays as rules name them, Monday first.
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def _property(block: Column, name: str) -> Column:
    """The last line of a property: its parameters and value."""
    lines = F.regexp_extract_all(block, F.lit(rf"(?im)^({name}(?:;[^:\n]*)?:[^\n]*)$"), F.lit(1))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def _value(line: Column) -> Column:
    return F.regexp_replace(line, r"^[^:]*:", "")


def _plain(value: Column) -> Column:
    """Text without escapes."""
    marked = F.regexp_replace(F.regexp_replace(value, r"\\\\", "\x01"), r"\\[nN]", "\n")
    return F.trim(F.replace(F.regexp_replace(marked, r"\\([,;])", "$1"), F.lit("\x01"), F.lit("\\")))


def _moment(value: Column) -> Column:
    """A date, or a date and time on the wall; null if it is neither."""
    v = F.regexp_replace(F.trim(value), "Z$", "")
    day = F.when(F.rlike(v, F.lit(r"^\d{8}$")), F.try_to_timestamp(v, F.lit("yyyyMMdd")))
    return F.coalesce(day, F.when(F.rlike(v, F.lit(r"^\d{8}T\d{6}$")), F.try_to_timestamp(F.replace(v, F.lit("T"), F.lit("")), F.lit("yyyyMMddHHmmss")))).cast("timestamp_ntz")


def _zone(line: Column, value: Column, default: str) -> Column:
    """UTC for a value that ends in Z, else the line's time zone if it is one, else the default."""
    named = F.regexp_extract(line, r"(?i);TZID=\"?([^;:\"]+)", 1)
    return F.when(F.endswith(F.trim(value), F.lit("Z")), "UTC").when(named.isin(sorted(available_timezones())), named).otherwise(default)


def _utc(wall: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)


def entries(calendars: DataFrame, ident: str, ics: str, zone: str = "UTC") -> DataFrame:
    """One row per entry that has a start: ident, uid, title, location, notes, start, end, all_day, rrule, exdates, and wall and zone of the start.

    Folded lines are put together. Times count in UTC; one without a zone is in
    `zone`. An entry without an end lasts its duration, else a day if it has no
    time of day, else an hour. A property that can't be read counts as missing.
    The session's time zone has to be UTC. Null and empty calendars have none.
    """
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(ics), F.lit("")), r"\r\n?", "\n"), r"\n[ \t]", "")
    blocks = calendars.select(F.col(ident), F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))).alias("_b"))
    start, end, span = (_property(F.col("_b"), n) for n in ("DTSTART", "DTEND", "DURATION"))
    lasted = [F.coalesce(F.regexp_extract(_value(span), r"^\s*P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?\s*$", i).try_cast("int"), F.lit(0)) for i in (1, 2, 3, 4)]
    whole_day = F.rlike(F.trim(_value(start)), F.lit(r"^\d{8}$"))
    seconds = lasted[0] * 86400 + lasted[1] * 3600 + lasted[2] * 60 + lasted[3]
    length = F.when(seconds > 0, seconds).when(whole_day, 86400).otherwise(3600)
    ex = F.regexp_extract_all("_b", F.lit(r"(?im)^(EXDATE(?:;[^:\n]*)?:[^\n]*)$"), F.lit(1))
    exdates = F.flatten(F.transform(ex, lambda line: F.transform(F.split(_value(line), ","), lambda v: _utc(_moment(v), _zone(line, v, zone)))))
    said = blocks.select(
        ident, *[_plain(_value(_property(F.col("_b"), p))).alias(n) for p, n in (("UID", "uid"), ("SUMMARY", "title"), ("LOCATION", "location"), ("DESCRIPTION", "notes"))],
        _moment(_value(start)).alias("wall"), _zone(start, _value(start), zone).alias("zone"), _utc(_moment(_value(end)), _zone(end, _value(end), zone)).alias("_end"),
        length.alias("_length"), whole_day.alias("all_day"), F.upper(F.trim(_value(_property(F.col("_b"), "RRULE")))).alias("rrule"), F.filter(exdates, lambda x: x.isNotNull()).alias("exdates"),
    ).where("wall IS NOT NULL")
    begin = _utc(F.col("wall"), F.col("zone"))
    return said.select(ident, "uid", "title", "location", "notes", begin.alias("start"), F.coalesce("_end", F.timestamp_seconds(F.unix_seconds(begin) + F.col("_length"))).alias("end"), "all_day", "rrule", "exdates", "wall", "zone")


def _in_month(first: Column, days: Column, named: Column) -> Column:
    """The dates of a month that rules with days of the month, or weekdays with or without a number, pick."""
    last = F.last_day(first)

    def numbered(x: Column) -> Column:
        forward = F.date_add(first, F.pmod(x["day"] - F.weekday(first), F.lit(7)).cast("int"))
        backward = F.date_sub(last, F.pmod(F.weekday(last) - x["day"], F.lit(7)).cast("int"))
        every = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.date_add(forward, (j * 7).cast("int")))
        one = F.when(x["n"] > 0, F.date_add(forward, ((x["n"] - 1) * 7).cast("int"))).otherwise(F.date_add(backward, ((x["n"] + 1) * 7).cast("int")))
        return F.when(x["n"] == 0, every).otherwise(F.array(one))

    by_number = F.transform(days, lambda n: F.when(n > 0, F.date_add(first, (n - 1).cast("int"))).otherwise(F.date_add(last, (n + 1).cast("int"))))
    by_name = F.flatten(F.transform(named, numbered))
    picked = F.when(F.size(named) == 0, by_number).when(F.size(days) == 0, by_name).otherwise(F.array_intersect(by_number, by_name))
    return F.array_sort(F.array_distinct(F.filter(picked, lambda d: (d >= first) & (d <= last))))


def occurrences(events: DataFrame, low: Column, high: Column) -> DataFrame:
    """events' rows once per occurrence that overlaps [low, high), with its start and end and whether a rule made it.

    Rules have FREQ (DAILY, WEEKLY, MONTHLY, YEARLY), INTERVAL, BYDAY (numbered
    in months and years), BYMONTHDAY, BYMONTH, COUNT, UNTIL; EXDATEs go. Only the
    periods that can reach the window are listed, however old a rule is; how many
    occurrences a counted rule had before is a product of periods, where every
    period has as many, and else a sum over them. Occurrences keep their time on
    the wall in their zone. An entry without a rule, or with one that has another
    FREQ, counts as it stands.
    """
    rule = F.str_to_map("rrule", F.lit(";"), F.lit("="))
    part = lambda name: F.trim(F.try_element_at(rule, F.lit(name)))
    number = lambda name: F.when(F.rlike(part(name), F.lit(r"^\d{1,9}$")), part(name).try_cast("int"))
    listed = lambda name: F.filter(F.transform(F.split(F.coalesce(part(name), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    weekday = lambda x: F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.substring(x, -2, 2)).cast("int") - 1
    named = F.filter(F.transform(listed("BYDAY"), lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), weekday(x).alias("day"))), lambda x: x["day"] >= 0)
    numbers = lambda name: F.filter(F.transform(listed(name), lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x != 0))
    rules = events.withColumns({
        "_freq": part("FREQ"), "_n": F.greatest(F.lit(1), F.coalesce(number("INTERVAL"), F.lit(1))), "_count": number("COUNT"), "_until": _moment(part("UNTIL")), "_until_day": F.rlike(part("UNTIL"), F.lit(r"^\d{8}$")),
        "_named": named, "_days": numbers("BYMONTHDAY"), "_months": numbers("BYMONTH"), "_d0": F.col("wall").cast("date"), "_span": F.unix_seconds("end") - F.unix_seconds("start"),
    })
    known = F.coalesce(F.col("_freq").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY"), F.lit(False))
    overlaps = (F.col("start") < high) & (F.col("end") > low)
    single = rules.where(~known & overlaps).select(*events.columns, F.lit(False).alias("occurrence"))
    r = rules.where(known)
    # a rule without days has those of its start
    weekly, monthly, yearly = (F.col("_freq") == f for f in ("WEEKLY", "MONTHLY", "YEARLY"))
    own_day = F.array(F.struct(F.lit(0).alias("n"), F.weekday("_d0").alias("day")))
    plain = (F.size("_named") == 0) & (F.size("_days") == 0)
    r = r.withColumns({
        "_named": F.when(weekly & (F.size("_named") == 0), own_day).otherwise(F.col("_named")),
        "_days": F.when((monthly | yearly) & plain, F.array(F.dayofmonth("_d0"))).otherwise(F.col("_days")),
        "_months": F.when(yearly & (F.size("_months") == 0), F.array(F.month("_d0"))).otherwise(F.col("_months")),
    })
    r = _written(r)  # what is read out of the rule is read once
    week0, month0 = F.date_sub("_d0", F.weekday("_d0")), F.trunc("_d0", "month")

    def picked(k: Column) -> Column:
        """The dates of period k, in order, whether or not they are before the start."""
        step = (k * F.col("_n")).cast("int")
        day = F.date_add("_d0", step)
        daily = F.when((F.size("_named") == 0) | F.exists("_named", lambda x: x["day"] == F.weekday(day)), F.array(day)).otherwise(F.array().cast("array<date>"))
        in_week = F.array_sort(F.array_distinct(F.transform("_named", lambda x: F.date_add(week0, (step * 7 + x["day"]).cast("int")))))
        in_month = _in_month(F.add_months(month0, step), F.col("_days"), F.col("_named"))
        year = F.trunc(F.add_months(month0, step * 12), "year")
        in_year = F.array_sort(F.flatten(F.transform("_months", lambda m: _in_month(F.add_months(year, (m - 1).cast("int")), F.col("_days"), F.col("_named")))))
        found = F.when(F.col("_freq") == "DAILY", daily).when(weekly, in_week).when(monthly, in_month).otherwise(in_year)
        limited = F.filter(found, lambda d: (F.size("_months") == 0) | F.array_contains("_months", F.month(d)))
        return F.filter(limited, lambda d: d >= F.col("_d0"))

    # periods that may reach the window, a day of slack for zones
    near, far = F.date_sub(F.timestamp_seconds(F.unix_seconds(low) - F.col("_span")).cast("date"), 1), F.date_add(high.cast("date"), 1)

    def period(day: Column) -> Column:
        months = F.floor(F.months_between(F.trunc(day, "month"), month0))
        passed = F.when(F.col("_freq") == "DAILY", F.datediff(day, "_d0")).when(weekly, F.floor(F.datediff(day, week0) / 7)).when(monthly, months).otherwise(F.year(day) - F.year("_d0"))
        return F.floor(passed / F.col("_n")).cast("int")

    r = r.withColumns({"_k0": F.greatest(F.lit(0), period(near)), "_k1": period(far)}).where("_k1 >= _k0")
    # every period has as many dates: plain days, weekdays of a week, days that no month lacks, weekdays numbered to the fourth
    even = (F.size("_months") == 0) & (
        ((F.col("_freq") == "DAILY") & (F.size("_named") == 0)) | weekly
        | (monthly & (F.size("_named") == 0) & F.forall("_days", lambda x: (x >= 1) & (x <= 28)))
        | (monthly & (F.size("_days") == 0) & F.forall("_named", lambda x: (F.abs(x["n"]) >= 1) & (F.abs(x["n"]) <= 4)) & (F.size("_named") == 1))
    )
    r = _written(r.withColumns({"_even": even, "_first": F.when(even, F.size(picked(F.lit(0)))), "_rest": F.when(even, F.size(picked(F.lit(1))))}))
    # a counted rule of even periods ends with the period that holds its last date, and no rule lasts beyond UNTIL (two days of slack for zones)
    ends = F.when(F.col("_even") & (F.col("_rest") > 0) & F.col("_count").isNotNull(), F.greatest(F.lit(0), F.ceil((F.col("_count") - F.col("_first")) / F.col("_rest")).cast("int")))
    r = r.withColumn("_k1", F.least("_k1", ends, period(F.date_add(F.col("_until").cast("date"), 2)))).where("_k1 >= _k0")
    made = _written(r.withColumn("_k", F.explode(F.sequence("_k0", "_k1"))).withColumn("_dates", picked(F.col("_k"))))
    summed = F.aggregate(F.sequence(F.lit(0), F.col("_k") - 1), F.lit(0), lambda s, k: s + F.size(picked(k)))
    place = F.when(F.col("_count").isNull() | (F.col("_k") == 0), 0).when(F.col("_even"), F.col("_first") + (F.col("_k") - 1) * F.col("_rest"))
    even_rows = made.where("_even OR _count IS NULL OR _k = 0").withColumn("_place", place)
    each = even_rows.unionByName(made.where("NOT _even AND _count IS NOT NULL AND _k > 0").withColumn("_place", summed)).select("*", F.posexplode("_dates").alias("_i", "_d"))
    each = each.where(F.col("_count").isNull() | (F.col("_place") + F.col("_i") < F.col("_count")))
    wall = F.expr("CAST(_d AS TIMESTAMP_NTZ) + (wall - CAST(_d0 AS TIMESTAMP_NTZ))")
    begin = _utc(wall, F.col("zone"))
    until_utc = F.when(F.endswith(part("UNTIL"), F.lit("Z")), F.col("_until").cast("timestamp")).otherwise(_utc(F.col("_until"), F.col("zone")))
    lives = F.col("_until").isNull() | F.when(F.col("_until_day"), F.col("_d") <= F.col("_until").cast("date")).otherwise(begin <= until_utc)
    found = each.where(lives).withColumns({"start": begin, "end": F.timestamp_seconds(F.unix_seconds(begin) + F.col("_span"))})
    found = found.where(overlaps & ~F.coalesce(F.array_contains("exdates", F.col("start")), F.lit(False)))
    return found.select(*events.columns, F.lit(True).alias("occurrence")).unionByName(single)
