"""Aggregate operators: rates, histograms, ledgers, merges, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import _written


def rates(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """total, and for each condition its count and its safe rate (0 without rows), rounded to 6."""
    aggs = [F.count("*").alias("total")]
    aggs += [F.count_if(c).alias(f"n_{name}") for name, c in conditions.items()]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"{name}_rate": F.round(F.coalesce(F.try_divide(f"n_{name}", "total"), F.lit(0.0)), 6) for name in conditions})


def histogram(df: DataFrame, keys: list[str], slot: Column, slots: int) -> DataFrame:
    """Counts per slot 0 to slots - 1 as one array, zeros included: one pass, combined before the shuffle."""
    counted = df.select(*keys, slot.alias("_s"))
    sums = [F.count_if(F.col("_s") == i) for i in range(slots)]
    return counted.groupBy(*keys).agg(F.array(*sums).alias("counts"), F.count("*").alias("n"))


def ledger(df: DataFrame, keys: list[str], ok: Column, elapsed: Column, ts: str) -> DataFrame:
    """calls, ok calls, last time, and mean elapsed over rows that have one (rounded to 3)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("n_ok"), F.max(ts).alias("last_ts"), F.round(F.avg(elapsed), 3).alias("mean_elapsed")
    )


def merge_sweep(df: DataFrame, keys: list[str], content: Column, ident: str, count: Column, support: str, dry: bool = False) -> DataFrame:
    """df's rows with status, observed, newest and support: of rows with equal keys and content the smallest id survives.

    The survivor has the merged count (each row counts once at least), the
    newest id and all sources; the others are merged. A dry sweep gives one row
    per group of several rows instead: keys, survivor and members. Groups are
    summed before the shuffle, and only ids and hashes, written once, travel.
    """
    keyed = _written(df.select(*keys, F.unhex(F.sha1(content)).alias("_c"), F.col(ident).alias("_id"), count.alias("_n"), F.col(support).alias("_s")))
    groups = keyed.groupBy(*keys, "_c").agg(
        F.min("_id").alias("survivor"),
        F.sum(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))).cast("long").alias("observed"),
        F.count("*").alias("members"),
        F.max("_id").alias("newest"),
        F.array_join(F.array_sort(F.collect_set("_s")), "|").alias("support"),
    )
    if dry:
        return groups.where("members > 1").select(*keys, "survivor", "members")
    own = keyed.select(*keys, "_c", F.col("_id").alias(ident)).join(groups, [*keys, "_c"])
    first = F.col(ident) == F.col("survivor")
    merged = [F.when(first, F.col(c)).alias(c) for c in ("observed", "newest")] + [F.when(first, F.nullif("support", F.lit(""))).alias("support")]
    return own.select(*keys, ident, F.when(first, "active").otherwise("merged").alias("status"), *merged)


def entropy(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Shannon entropy (nats) of the items of each group: two combined aggregates, no window."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    sums = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.log("_n")).alias("_s"))
    return sums.select(*keys, "n", F.round(F.greatest(F.lit(0.0), F.log("n") - F.col("_s") / F.col("n")), 6).alias("entropy"))


def counts_as_map(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per group its item counts as a sorted 'item:count' list; null items are left out."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.concat_ws(":", item, F.col("_n").cast("string"))))
    return counts.groupBy(*keys).agg(F.array_join(entries, ",").alias("counts"), F.sum("_n").alias("total"))


def worst_state(df: DataFrame, keys: list[str], state: Column, order: list[str]) -> DataFrame:
    """Counts of every state, zeros included, and the first in `order` that occurs."""
    s = df.select(*keys, state.alias("_state"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("_state"))
    aggs = [F.count_if(F.col("_state") == name).alias(f"n_{name}") for name in order]
    return s.groupBy(*keys).agg(*aggs, F.min_by("_state", place).alias("worst"))
