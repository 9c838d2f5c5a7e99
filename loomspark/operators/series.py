"""Recurrence detection over event series: one aggregate per key, then array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gaps(days: Column) -> Column:
    """Days between successive dates of a sorted array."""
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(days))), lambda i: F.datediff(F.get(days, i - 1), F.get(days, i - 2)))


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    low, high = F.floor((F.size(s) - 1) / 2).cast("int"), F.floor(F.size(s) / 2).cast("int")
    return (F.get(s, low) + F.get(s, high)) / 2.0


def _dominant(values: Column) -> Column:
    """(c, at, v): the commonest value, of equally common ones the first seen, with its count."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("c"), (-F.array_position(values, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)


def detect_rhythm(events: DataFrame, key: str, ts: str, least: int = 4) -> DataFrame:
    """Per key the recurrence of its days: kind, period in days, share, n and confidence; keys without one are left out.

    In this order: weekly or biweekly (one weekday holds 70 %, 21 days span,
    its median gap is 5-9 or 12-16 days), monthly by day or by the nth or last
    weekday of the month (70 %, 60 days span), interval (median gap of 2 days or
    more, 60 % of gaps near a multiple of it). confidence = share * min(1, n / 8).

    One shuffle: a key's state is the set of its days, bounded by the calendar,
    however many events it has.
    """
    days = events.where(F.col(ts).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.to_date(ts))).alias("days")).where(F.size("days") >= least)
    last = lambda x: F.month(F.date_add(x, 7)) != F.month(x)
    nth = lambda x: F.weekday(x) * 10 + F.when(last(x), 9).otherwise(F.ceil(F.dayofmonth(x) / 7))
    slots = days.select(
        key,
        "days",
        F.size("days").alias("n"),
        F.datediff(F.get("days", F.size("days") - 1), F.get("days", F.lit(0))).alias("span"),
        F.transform("days", lambda x: F.weekday(x)).alias("wds"),
        F.transform("days", lambda x: F.dayofmonth(x)).alias("doms"),
        F.transform("days", lambda x: nth(x).cast("int")).alias("nths"),
        _gaps(F.col("days")).alias("gaps"),
    )
    found = slots.select("*", *[_dominant(F.col(c)).alias(name) for c, name in (("wds", "wd"), ("doms", "dom"), ("nths", "nth"))], _median(F.col("gaps")).alias("med"))
    same = F.filter("days", lambda x: F.weekday(x) == F.col("wd.v"))
    found = found.withColumn("wd_med", F.when(F.size(same) > 1, _median(_gaps(same))).otherwise(7.0))
    near = F.filter("gaps", lambda g: F.abs(g - F.greatest(F.lit(1.0), F.rint(g / F.col("med"))) * F.col("med")) <= F.greatest(F.lit(1.0), 0.25 * F.col("med")))
    share = {name: F.col(f"{name}.c") / F.col("n") for name in ("wd", "dom", "nth")} | {"gap": F.size(near) / F.size("gaps")}
    often, long = (share["wd"] >= 0.7) & (F.col("span") >= 21), F.col("span") >= 60
    rules = (
        (often & F.col("wd_med").between(5, 9), "weekly", F.lit(7.0), share["wd"]),
        (often & F.col("wd_med").between(12, 16), "biweekly", F.lit(14.0), share["wd"]),
        (long & (share["dom"] >= 0.7), "monthly-dom", F.lit(30.0), share["dom"]),
        (long & (share["nth"] >= 0.7), "monthly-nth", F.lit(30.0), share["nth"]),
        ((F.col("med") >= 2) & (share["gap"] >= 0.6), "interval", F.col("med"), share["gap"]),
    )
    rhythm = F.coalesce(*[F.when(holds, F.struct(F.lit(kind).alias("kind"), period.alias("period"), part.alias("share"))) for holds, kind, period, part in rules])
    out = found.select(key, "n", rhythm.alias("r")).where("r IS NOT NULL").select(key, "n", "r.*")
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("share") * F.least(F.lit(1.0), F.col("n") / 8)), 3)).withColumn("share", F.round("share", 6))


def store_rhythms(stored: DataFrame, found: DataFrame, label: str, least: float = 0.4) -> DataFrame:
    """The stored rhythms after a detection: confident ones are stored or refreshed and become active, dismissed ones stay as they are."""
    fresh = found.where(F.col("confidence") >= least)
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, F.col(f"s.{label}") == F.col(f"f.{label}"), "full_outer")
    keeps = (F.col("s.status") == "dismissed") | F.col(f"f.{label}").isNull()
    values = [F.when(keeps, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("kind", "period", "confidence")]
    return both.select(F.coalesce(f"s.{label}", f"f.{label}").alias(label), *values, F.when(keeps, F.col("s.status")).otherwise("active").alias("status"))


def expand_intervals(rows: DataFrame, ident: list[str], start: str, until: str, step_days: str, skipped: DataFrame, low, high) -> DataFrame:
    """Occurrences (every step days from start to until) in a window of dates, without the skipped (ident, day) ones."""
    day = F.explode_outer(F.expr(f"sequence({start}, {until}, make_interval(0, 0, 0, cast({step_days} AS INT)))")).alias("day")
    out = rows.select(*ident, day)
    return out.where((F.col("day") >= low) & (F.col("day") <= high)).join(skipped, [*ident, "day"], "left_anti")
