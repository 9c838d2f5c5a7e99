"""Entity-graph operators: nodes, refusals, validity intervals, mentions, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .joins import phrases_in
from .windows import top_per_group


def resolve_nodes(mentions: DataFrame) -> DataFrame:
    """One node per (type, normal form) of (type, label): mentions, first label in order and sorted aliases."""
    keyed = mentions.withColumn("norm", norm(F.col("label"))).where("norm <> ''")
    return keyed.groupBy("type", "norm").agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("aliases"))


def refusal(src: Column, dst: Column, rel: Column, grounded: Column, anchor: str, identity: tuple[str, ...]) -> Column:
    """Why an extracted edge is refused, or null: incomplete, self-loop, identity claim about the anchor, not grounded."""
    incomplete = (norm(src) == "") | (norm(dst) == "") | (norm(rel) == "")
    claims = (norm(src) == anchor) & norm(rel).isin(*identity)
    return (
        F.when(incomplete, "incomplete").when(norm(src) == norm(dst), "self_loop").when(claims, "identity").when(~F.coalesce(grounded, F.lit(False)), "ungrounded")
    )


def validity(edges: DataFrame, src: str, rel: str, dst: str, ts: str, tie: str) -> DataFrame:
    """Bitemporal facts of relations that hold one value: each run of a value from its first assertion until the next value's.

    Asserting the same value again adds to mentions; a value that returns opens
    a new interval.
    """
    w = Window.partitionBy(src, rel).orderBy(ts, tie)
    changed = F.when(F.col(dst).eqNullSafe(F.lag(dst).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = edges.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    facts = runs.groupBy(src, rel, "_run").agg(F.first(dst).alias(dst), F.min(ts).alias("valid_from"), F.count("*").alias("mentions"))
    r = Window.partitionBy(src, rel).orderBy("_run")
    return facts.withColumn("valid_to", F.lead("valid_from").over(r)).withColumn("active", F.col("valid_to").isNull()).drop("_run")


def ground(quotes: DataFrame, turns: DataFrame, on: str, least: int = 6) -> DataFrame:
    """Quotes with the first turn of their conversation whose normal form holds theirs; null if none does or the quote is short."""
    q = quotes.withColumn("_q", norm(F.col("quote")))
    t = turns.select(F.col(on).alias("_on"), F.col("turn").alias("_turn"), norm(F.col("text")).alias("_t"))
    held = (F.col("_on") == F.col(on)) & F.contains("_t", F.col("_q")) & (F.length("_q") >= least)
    return q.join(t, held, "left").groupBy(*quotes.columns).agg(F.min("_turn").alias("grounded_turn"))


def context(texts: DataFrame, ident: str, text: str, nodes: DataFrame, edges: DataFrame, most_nodes: int = 6, most_facts: int = 12) -> DataFrame:
    """(ident, place, fact): facts of the entities that a text mentions, whole labels at white-space boundaries.

    nodes (label, mentions), edges (src, rel, dst, weight). The most mentioned
    entities come first, then the weightiest of their facts; a fact that both of
    its ends bring in counts once. A label's `most_facts` weightiest facts are
    enough, so they are chosen before any text meets them.
    """
    met = phrases_in(texts, [ident], F.col(text), nodes, "label")
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("mentions"), F.asc("label")))
    hits = met.select(ident, "label", rank.alias("rn")).where(F.col("rn") <= most_nodes)
    once = edges.groupBy(F.concat_ws(" ", "src", "rel", "dst").alias("fact"), "src", "dst").agg(F.max("weight").alias("weight"))
    ends = once.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("label"), "fact", "weight")
    ends = top_per_group(ends, ["label"], [F.desc("weight"), F.asc("fact")], most_facts)
    facts = hits.join(ends, "label").groupBy(ident, "fact").agg(F.min("rn").alias("rn"), F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy(ident).orderBy(F.asc("rn"), F.desc("weight"), F.asc("fact")))
    return facts.select(ident, place.alias("place"), "fact").where(F.col("place") <= most_facts)


def cooccurrence(items: DataFrame, group: list[str], item: str, least: int, most: int = 12) -> DataFrame:
    """(a, b, n): how many groups hold both items, from each group's first `most` distinct items (the feature's cap)."""
    sets = items.groupBy(*group).agg(F.slice(F.array_sort(F.collect_set(item)), 1, most).alias("_s"))
    left = sets.select("_s", F.posexplode("_s").alias("_i", "a"))
    pairs = left.select("a", F.explode_outer(F.slice("_s", F.col("_i") + 2, F.lit(most))).alias("b")).where("b IS NOT NULL")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
