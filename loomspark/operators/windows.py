"""Row-choosing operators over windows: latest, top n, caps, change points, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark's group limit drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Latest value of each key, as an aggregate that is combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_per_day(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The first occurrence of each key on each calendar day."""
    return top_per_group(df.withColumn("day", F.to_date(ts)), [*keys, "day"], [F.asc(ts), F.asc(tie)], 1)


def gaps(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Whole days between successive occurrences of a key."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    return df.withColumn("gap_days", F.datediff(F.to_date(ts), F.to_date(F.lag(ts).over(w)))).where("gap_days IS NOT NULL")


def sessions(df: DataFrame, keys: list[str], ts: str, tie: str, starts: Column) -> DataFrame:
    """Groups that open at rows where `starts` holds: session number from 0 and seconds since its first row."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    numbered = df.withColumn("session", F.sum(starts.cast("long")).over(w))
    own = Window.partitionBy(*keys, "session").orderBy(ts, tie)
    return numbered.withColumn("offset_s", F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.first(ts).over(own).cast("timestamp")))


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Leading rows of each group while their sizes add up to the budget; the first always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    return marked.where((F.col("running") <= budget) | (F.col("_rn") == 1)).drop("_rn")


def history(df: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """Slowly changing values: each change with the time it holds from and to (null: still) and whether it is active."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    changed = change_points(df, keys, value, ts, tie)
    ended = changed.withColumn("valid_to", F.lead(ts).over(w)).withColumn("superseded_by", F.lead(tie).over(w))
    return ended.withColumnRenamed(ts, "valid_from").withColumn("active", F.col("valid_to").isNull())


def change_points(df: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    before = df.withColumn("_before", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    return before.where((F.col("_rn") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_rn")
