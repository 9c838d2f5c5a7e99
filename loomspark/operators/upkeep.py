"""Upkeep of stored rows: gates, cursors, one-shot delivery, profiles, carried-over state, keys that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import half_life
from ..functions.text import norm


def append(df: DataFrame, path: str, by: str) -> None:
    """Append rows to a partitioned table, one folder for each value: documents by kind, logs by day."""
    df.write.partitionBy(by).mode("append").parquet(path)


def running(sessions: DataFrame, started: str, ended: str, seen: str, now: Column, stale_s: float) -> DataFrame:
    """Sessions that are open and were seen within stale_s."""
    return sessions.where(F.col(started).isNotNull() & F.col(ended).isNull() & (now - F.col(seen) < stale_s))


def refreshable(sources: DataFrame, fetched: DataFrame, key: str, at: str, now: Column, ttl: Column) -> DataFrame:
    """Sources that were never fetched, or not within their time to live."""
    last = fetched.groupBy(key).agg(F.max(at).alias("_last"))
    return sources.join(last, key, "left").where(F.col("_last").isNull() | (now - F.col("_last") >= ttl)).drop("_last")


def due_once(reminders: DataFrame, delivered: DataFrame, key: str, due: str, now: Column) -> DataFrame:
    """Due rows that have not been delivered; the caller appends what it delivers."""
    return reminders.where(F.col(due) <= now).join(delivered.select(key).distinct(), key, "left_anti")


def next_page(rows: DataFrame, order: list[Column], offset: int, limit: int, seen: DataFrame, key: str) -> DataFrame:
    """The rows of a crawl's next page that it has not seen; an empty page means that the cursor starts again."""
    return rows.orderBy(*order).offset(offset).limit(limit).join(seen.select(key).distinct(), key, "left_anti")


def after_watermark(rows: DataFrame, key: str, watermark: Column | int, most: int) -> DataFrame:
    """The next rows above a watermark, `most` at a time, in order of the key."""
    mark = watermark if isinstance(watermark, Column) else F.lit(watermark)
    return rows.where(F.col(key) > mark).orderBy(key).limit(most)


def reopen(rows: DataFrame, answer: str, status: str, dead_ends: tuple[str, ...]) -> DataFrame:
    """Rows whose answer is blank or holds one of the phrases of a dead end go back to pending, without their answer."""
    said = norm(F.col(answer))
    dead = said == ""
    for phrase in dead_ends:
        dead = dead | F.contains(said, F.lit(phrase.lower()))
    dead = dead & (F.col(status) == "done")
    return rows.withColumns({status: F.when(dead, "pending").otherwise(F.col(status)), answer: F.when(~dead, F.col(answer))})


def find_person(people: DataFrame, name: str, aliases: str, wanted: Column) -> DataFrame:
    """People whose name, or one whole alias of a comma-separated list, is the wanted one in normal form."""
    listed = F.transform(F.split(F.coalesce(aliases, F.lit("")), ","), lambda a: norm(a))
    return people.where((norm(F.col(name)) == norm(wanted)) | F.array_contains(listed, norm(wanted)))


def profile(facts: DataFrame, key: str, facet: str, fact: str, weight: str, least: float, most: int) -> DataFrame:
    """(key, facet, card): the facts of each facet that weigh `least` or more, heaviest first, `most` at a time, joined by '; '."""
    held = facts.where(F.col(weight) >= least)
    listed = F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(fact).alias("f"))))
    grouped = held.groupBy(key, facet).agg(listed.alias("_l"))
    return grouped.select(key, facet, F.array_join(F.transform(F.slice("_l", 1, most), lambda x: x["f"]), "; ").alias("card"))


def carried_over(state: DataFrame, value: str, at: str, now: Column, half: float, factor: float, least: float) -> DataFrame:
    """Activation of an earlier conversation as a new one begins with it: decayed, scaled, dormant; what is below `least` is left."""
    later = F.round(F.col(value) * factor * half_life(F.greatest(F.lit(0.0), now - F.col(at)), half), 6)
    return state.withColumn(value, later).where(F.col(value) >= least).withColumn("dormant", F.lit(True))


def merge_maps(left: Column, right: Column) -> Column:
    """Maps of maps merged: the right one wins, key by key on both levels; null is an empty map."""

    def inner(_: Column, a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda _k, x, y: F.coalesce(y, x)))

    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_zip_with(left, right, inner))


def rekey(nodes: DataFrame, key: Column, name: str, mentions: str, aliases: str) -> DataFrame:
    """Nodes under a new key: those that fall together become one, with summed mentions and all aliases."""
    return nodes.groupBy(key.alias(name)).agg(F.sum(mentions).alias(mentions), F.array_join(F.array_sort(F.collect_set(aliases)), "|").alias(aliases))


def retract(edges: DataFrame, src: str, dst: str, gone: DataFrame, anchor: Column) -> DataFrame:
    """Edges with a status: retracted if a node at either end is (the anchor can't be), else active."""
    nodes = gone.where(F.col("node") != anchor).select("node").distinct()
    hit = edges.join(nodes.withColumnRenamed("node", "_a"), F.col(src) == F.col("_a"), "left").join(nodes.withColumnRenamed("node", "_b"), F.col(dst) == F.col("_b"), "left")
    return hit.withColumn("status", F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), "retracted").otherwise("active")).drop("_a", "_b")
