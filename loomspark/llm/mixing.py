"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, if_small, n_words, ranked

#: Words that are left to the dynamic programme: so many times the median document, at most DP_WORDS; up to them again where the sum isn't met.
DP_MEDIANS, DP_WORDS = 16, 1 << 22
_CHUNK = 1 << 18


def reachable(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of `free` documents of each length to take so that the sum is the largest one up to budget: a bounded knapsack.

    Reachable sums are the bits of one integer; every length's documents come in
    lots of 1, 2, 4, ... For each sum the first lot that reaches it is noted, so
    the way back only meets earlier lots. It ends when the budget is reached.
    Lengths come in the order of a hash, so none are preferred.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    lots: list[tuple[int, int, int]] = []  # (place, documents, words)
    by = np.full(budget + 1, -1, np.int32)
    mask, sums = (1 << (budget + 1)) - 1, 1
    for i in np.argsort(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable").tolist():
        size, left, lot = int(lengths[i]), int(free[i]), 1
        left = min(left, budget // size) if size else 0
        while left > 0 and not sums >> budget & 1:
            lot = min(lot, left)
            new = (sums << lot * size) & mask & ~sums
            if new:
                data = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                for start in range(0, len(data), _CHUNK):
                    at = start + np.flatnonzero(data[start : start + _CHUNK])
                    row, bit = np.nonzero(np.unpackbits(data[at, None], axis=1, bitorder="little"))
                    by[at[row] * 8 + bit] = len(lots)
                lots.append((i, lot, lot * size))
                sums |= new
            left -= lot
            lot *= 2
    at = sums.bit_length() - 1
    while at:
        i, n, words = lots[by[at]]
        taken[i] += n
        at -= words
    return taken


def equal_share(lengths: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Documents of each length that together have up to `words` words, the same share of every length.

    From the longest length down, what a length's share lacks of a whole
    document is carried to the next one, so the sum is short by less than the
    shortest document if that has one to spare. Where all shorter documents
    together couldn't make up for it, one more is taken and they get less.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = sum(n * c for n, c in zip(lengths.tolist(), counts.tolist()))
    if words <= 0 or not total:
        return taken
    carried, rest = 0, total  # in words times total, and in words
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, count = int(lengths[i]), int(counts[i])
        if size:
            carried += count * size * words
            rest -= count * size
            taken[i] = min(count, max(0, carried // (size * total)))
            carried -= int(taken[i]) * size * total
            lacks = size * total - carried
            if taken[i] < count and carried > rest * (total - words) and lacks <= rest * words:
                taken[i] += 1
                carried = -lacks
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to budget, or just under.

    An equal share of every length comes first, at any size, up to DP_MEDIANS
    median documents below the budget; the bounded knapsack over all lengths fits
    the rest. Where no sum meets it exactly, less is shared and the knapsack gets
    four times the words, up to DP_WORDS or the whole budget, where its sum is
    the best there is.
    """
    total = sum(n * c for n, c in zip(lengths.tolist(), counts.tolist()))
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    budget = min(int(budget), total)
    order = np.argsort(lengths, kind="stable")
    median = int(lengths[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])
    window = min(DP_MEDIANS * max(1, median), DP_WORDS)
    while True:
        taken = equal_share(lengths, counts, budget - window)
        left = budget - sum(n * c for n, c in zip(lengths.tolist(), taken.tolist()))
        # a long document that no share was due to may leave more than the window
        more = equal_share(lengths, counts - taken, left - window)
        left -= sum(n * c for n, c in zip(lengths.tolist(), more.tolist()))
        taken += more
        last = reachable(lengths, counts - taken, min(left, 4 * DP_WORDS))
        met = sum(n * c for n, c in zip(lengths.tolist(), last.tolist()))
        if met == left or window >= min(budget, DP_WORDS):
            return taken + last
        window *= 4


def source_targets(by_source: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size) with target: shares by weight, none above most times its source's size.

    Sources are ranked by a range sort. A source stops at its most when its
    share, `level` times its weight, would reach it; each round sums what has
    stopped and raises the level for the others, until no more stop. Only those
    sums go to the driver, so any number of sources will do.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    placed = checkpointed(ranked(by_source, F.col("source").asc_nulls_last(), name="_place").withColumn("_w", weight).drop("_place"))
    size = F.col("source_size")
    every = placed.agg(F.sum(size), F.sum("_w")).first()
    whole, level, before = budget * float(every[0] or 0), 0.0, -1
    shares = float(every[1] or 0)
    while shares > 0:
        level = whole / shares
        stops = size * most <= F.col("_w") * F.lit(level)
        n, full, rest = placed.agg(F.count_if(stops), F.sum(F.when(stops, size)), F.sum(F.when(~stops, F.col("_w")))).first()
        if n == before:
            break
        before, whole, shares = n, budget * float(every[0]) - most * float(full or 0), float(rest or 0)
    # where all have stopped, none is below its most
    target = F.least(size * most, F.col("_w") * F.lit(level)) if shares > 0 else size * most
    return placed.select("source", "source_size", target.cast("double").alias("target"))


def plan_of(slim: DataFrame, weights: tuple[float, ...], budget: float, most: int) -> DataFrame:
    """(source, size, source_size, target, whole, extra) of every length of every source: `whole` of all its documents and `extra` of them once more."""
    lengths = slim.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, budget, most)

    def fit(one: pd.DataFrame) -> pd.DataFrame:
        size, target = int(one.source_size.iloc[0]), float(one.target.iloc[0])
        whole = min(most, int(target // size)) if size else 0
        extra = np.zeros(len(one), np.int64)
        if size and whole < most:
            extra = fit_counts(one["size"].to_numpy(), one["n"].to_numpy(), int(target + 1e-6) - whole * size)
        return pd.DataFrame({"source": one.source, "size": one["size"], "source_size": size, "target": target, "whole": whole, "extra": extra})

    # a group is one source's lengths: it grows with the longest text, not with the documents
    histogram = lengths.join(targets, lengths.source.eqNullSafe(targets.source)).drop(targets.source)
    return checkpointed(histogram.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, whole long, extra long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    Sources in code-point order (null last) weigh `weights`, repeating, and share
    `budget` times all words; a target stops at `most` times its source's words
    and the excess is shared again. A source's target is whole passes over its
    documents and a remainder, for which documents are counted by exact length,
    a bounded knapsack says how many of each length to take, and the first of
    each length in the order of a seeded hash of doc_id and text are taken.

    Null or wordless texts have size 0; an empty table gives an empty result. A
    null doc_id is a value like any other. Of a very long text only its length
    counts, as the knapsack's array has 4 * DP_WORDS entries at most. Rows equal
    in doc_id, source and text are documents of their own: where only some of
    them are wanted, as many of the equal rows are taken. Columns of docs named
    like the ones added are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*added)
    draw, source, size, last = (fresh(docs.columns, n) for n in ("_draw", "_source", "_size", "_last"))
    docs = docs.withColumn("size", n_words(F.col("text"))).withColumn(draw, F.xxhash64(F.lit(seed), "doc_id", "text"))
    slim = checkpointed(docs.select("source", "size", F.col(draw).alias("draw")))
    plan = plan_of(slim, weights, budget, most)
    # the draw that closes each length's choice: that of the extra-th document in its order
    line = ranked(slim, "source", "size", "draw", name="rank")
    first = line.groupBy("source", "size").agg(F.min("rank").alias("first"))
    wanted = plan.where("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "extra")
    cut = first.join(wanted, F.expr("source <=> s AND size = z")).select((F.col("first") + F.col("extra") - 1).alias("rank"))
    closing = line.join(if_small(checkpointed(cut), 200_000), "rank").select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("draw").alias("last"), F.col("rank").alias("closes")
    )
    # of several documents with that draw only those up to the rank are taken
    tied = line.join(if_small(checkpointed(closing), 200_000), F.expr("source <=> s AND size = z AND draw = last"))
    tied = tied.groupBy("s", "z", "last", "closes").agg(F.count("*").alias("n"), F.min("rank").alias("least"))
    tied = tied.select(F.col("s").alias("source"), F.col("z").alias("size"), F.col("last").alias("draw"), "n", (F.col("closes") - F.col("least") + 1).alias("some"))
    plan = plan.alias("p").join(tied.alias("t"), F.expr("p.source <=> t.source AND p.size = t.size"), "left")
    plan = checkpointed(
        plan.select(F.col("p.source").alias(source), F.col("p.size").alias(size), "source_size", "target", "whole", "extra", F.col("draw").alias(last), "n", "some")
    )
    names = {c: fresh(docs.columns, f"_{c}") for c in ("whole", "extra", "n", "some")}
    plan = plan.withColumnsRenamed(names)
    whole, extra, n, some = (F.col(names[c]) for c in names)
    mixed = docs.join(if_small(plan, 200_000), F.col("source").eqNullSafe(F.col(source)) & (F.col("size") == F.col(size)))
    chosen = (extra > 0) & ((F.col(draw) < F.col(last)) | ((F.col(draw) == F.col(last)) & (n == some)))
    kept = [c for c in docs.columns if c != draw]
    sure = (whole + F.when(chosen, 1).otherwise(0)).cast("int")
    if plan.where(n > some).isEmpty():
        return mixed.withColumn("copies", sure).select(*kept, *added[1:])
    # equal documents of which only some are wanted are told apart by their rank
    split = (F.col(draw) == F.col(last)) & (n > some) & (extra > 0)
    plain = mixed.where(~F.coalesce(split, F.lit(False))).withColumn("copies", sure).select(*kept, *added[1:])
    place, row = fresh(mixed.columns, "_place"), fresh(mixed.columns, "_row")
    equal = ranked(mixed.where(split).withColumn(row, F.monotonically_increasing_id()), source, size, draw, row, name=place)
    least = equal.groupBy(F.col(source).alias("s"), F.col(size).alias("z")).agg(F.min(place).alias("l"))
    equal = equal.join(F.broadcast(least) if least.count() <= 200_000 else least, F.col(source).eqNullSafe(F.col("s")) & (F.col(size) == F.col("z")))
    copies = (whole + F.when(F.col(place) - F.col("l") < some, 1).otherwise(0)).cast("int")
    return plain.unionByName(equal.withColumn("copies", copies).select(*kept, *added[1:]))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs, unchanged, as often as it is taken."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = mix(rows, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
