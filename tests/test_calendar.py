"""Calendar entries and occurrences against another evaluator of the rules."""

import datetime as dt
import random

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from loomspark.operators import calendar

ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:a\r\nSUMMARY:Long\r\n  title\\, with \\\\ marks\\nand lines\r\nDTSTART;TZID=Europe/Berlin:20240610T090000\r\nDTEND;TZID=Europe/Berlin:20240610T103000\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nEXDATE;TZID=Europe/Berlin:20240617T090000,20240701T090000\r\nEND:VEVENT\r\nBEGIN:VEVENT\nUID:b\nDTSTART;VALUE=DATE:20240611\nLOCATION:Hall\nEND:VEVENT\nBEGIN:VEVENT\nUID:c\nDTSTART:20240612T080000Z\nDURATION:P1DT2H\nDESCRIPTION:x\;y\nEND:VEVENT\nBEGIN:VEVENT\nUID:d\nDTSTART:never\nEND:VEVENT\nBEGIN:VEVENT\nUID:e\nDTSTART;TZID=No/Where:20240612T080000\nDTEND:bad\nRRULE:FREQ=HOURLY\nEND:VEVENT\nEND:VCALENDAR"


def test_entries(spark):
    cals = spark.createDataFrame([(1, ICS), (2, None), (3, "")], "cal long, ics string")
    got = {r.uid: r for r in calendar.entries(cals, "cal", "ics").collect()}
    assert set(got) == {"a", "b", "c", "e"}
    a = got["a"]
    assert a.title == "Long title, with \\ marks\nand lines" and (a.start, a.end) == (dt.datetime(2024, 6, 10, 7), dt.datetime(2024, 6, 10, 8, 30)) and a.exdates == [dt.datetime(2024, 6, 17, 7), dt.datetime(2024, 7, 1, 7)]
    assert got["b"].all_day and got["b"].end == dt.datetime(2024, 6, 12) and got["b"].location == "Hall"
    assert got["c"].end - got["c"].start == dt.timedelta(days=1, hours=2) and got["c"].notes == "x;y"
    assert got["e"].start == dt.datetime(2024, 6, 12, 8) and got["e"].end == dt.datetime(2024, 6, 12, 9)
    seen = calendar.occurrences(calendar.entries(cals, "cal", "ics"), F.lit("2024-06-01").cast("timestamp"), F.lit("2024-12-01").cast("timestamp")).collect()
    assert sorted((r.uid, r.start) for r in seen) == [("a", dt.datetime(2024, 6, 10, 7)), ("a", dt.datetime(2024, 6, 24, 7)), ("b", dt.datetime(2024, 6, 11)), ("c", dt.datetime(2024, 6, 12, 8)), ("e", dt.datetime(2024, 6, 12, 8))]
    winter = cals.limit(1).select("cal", F.lit("BEGIN:VEVENT\nDTSTART;TZID=Europe/Berlin:20240923T090000\nRRULE:FREQ=MONTHLY\nEND:VEVENT").alias("ics"))
    walls = calendar.occurrences(calendar.entries(winter, "cal", "ics"), F.lit("2024-09-01").cast("timestamp"), F.lit("2024-12-01").cast("timestamp")).collect()
    assert sorted(r.start.hour for r in walls) == [7, 7, 8]  # nine on the wall, before and after the clocks change


def rules(rng):
    days = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
    some = lambda x, k: ",".join(rng.sample(x, rng.randint(1, k)))
    for _ in range(140):
        freq = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "MONTHLY", "YEARLY"])
        r = f"FREQ={freq}"
        if rng.random() < 0.6:
            r += f";INTERVAL={rng.randint(1, 4)}"
        if freq in ("DAILY", "WEEKLY") and rng.random() < 0.5:
            r += ";BYDAY=" + some(days, 3)
        if freq == "MONTHLY":
            r += rng.choice(["", ";BYDAY=" + rng.choice(["2TU", "-1FR", "1MO", "5WE", "TH", "1MO,3MO", "-2SU"]), ";BYMONTHDAY=" + rng.choice(["1", "15,28", "31", "-1", "30", "29,-2"])])
        if freq == "YEARLY":
            r += rng.choice(["", ";BYMONTH=" + rng.choice(["2", "3,11"]), ";BYMONTH=5;BYDAY=2SU"])
        end = rng.random()
        if end < 0.4:
            r += f";COUNT={rng.randint(1, 40)}"
        elif end < 0.6:
            r += f";UNTIL=20{rng.randint(10, 24)}0{rng.randint(1, 9)}15T120000Z"
        yield r


@pytest.mark.parametrize("window", [("2023-03-01", "2023-07-15"), ("2008-01-01", "2010-01-01"), ("2011-12-20", "2012-03-05")])
def test_occurrences_of_random_rules(spark, window):
    rng = random.Random(11)
    low, high = (dt.datetime.fromisoformat(x) for x in window)
    rows, want = [], set()
    for i, r in enumerate(rules(rng)):
        start = dt.datetime(2008, 1, 1) + dt.timedelta(days=rng.randint(0, 900), hours=rng.randint(0, 23))
        rows.append((i, f"BEGIN:VEVENT\nUID:{i}\nDTSTART:{start:%Y%m%dT%H%M%SZ}\nDURATION:PT5H\nRRULE:{r}\nEND:VEVENT"))
        utc = dt.timezone.utc
        for o in rrulestr(r, dtstart=start.replace(tzinfo=utc)).between((low - dt.timedelta(hours=5)).replace(tzinfo=utc), high.replace(tzinfo=utc)):
            if o.replace(tzinfo=None) + dt.timedelta(hours=5) > low:
                want.add((i, o.replace(tzinfo=None)))
    events = calendar.entries(spark.createDataFrame(rows, "cal long, ics string"), "cal", "ics")
    got = [(r.cal, r.start) for r in calendar.occurrences(events, F.lit(low), F.lit(high)).collect()]
    assert len(got) == len(set(got))
    named = dict((i, x.split("RRULE:")[1].split("\n")[0]) for i, x in rows)
    assert {(named[i], i, s) for i, s in set(got) ^ want} == set()
