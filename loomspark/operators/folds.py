"""Order-dependent folds: fluency, outcomes, the step of an activation state, keyphrases.

Where a fold has a combinable form it is an aggregate; activation and the phrase
graph are in working.py, greedy choices in greedy.py.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

#: Decay time in seconds, boost of a hit, floor and cap of an activation state (`working.activation` has the boost of a mention too).
TAU, BOOST, FLOOR, MOST = 900.0, 0.5, 0.02, 1024


def fluency(df: DataFrame, keys: list[str], order: str, signal: str) -> DataFrame:
    """Level per key: each use adds 0.05 up to 1.0, 'expert' lifts it to 0.9 at least, 'advanced' to 0.7.

    The clamp commutes with what follows, so the level is the most of 0.05 for
    every use and of each lift with 0.05 for every use after its first: sums
    that are combined before the shuffle, without any key's rows in one place.
    """
    lifts = {"expert": 0.9, "advanced": 0.7}
    firsts = df.groupBy(*keys).agg(*[F.min(F.when(F.col(signal) == name, F.col(order))).alias(f"_{name}") for name in lifts])
    after = [F.count_if(F.col(order) > F.col(f"_{name}")).alias(f"_n_{name}") for name in lifts]
    counts = df.join(firsts, keys).groupBy(*keys, *[f"_{name}" for name in lifts]).agg(F.count("*").alias("n"), *after)
    levels = [F.when(F.col(f"_{name}").isNotNull(), level + 0.05 * F.col(f"_n_{name}")) for name, level in lifts.items()]
    return counts.select(*keys, "n", F.round(F.least(F.lit(1.0), F.greatest(0.05 * F.col("n"), *levels)), 6).alias("fluency"))


def activate(
    now: float, items: list[str], state: dict[str, float], last: float | None, boost: float = BOOST, tau: float = TAU, floor: float = FLOOR, most: int = MOST
) -> dict[str, float]:
    """State after decay since `last`, floor, boosts (clamped at 1) and the cap."""
    if last is not None and now > last:
        by = math.exp(-(now - last) / tau)
        state = {k: v * by for k, v in state.items() if v * by >= floor}
    for item in items:
        state[item] = min(1.0, state.get(item, 0.0) + boost)
    if len(state) > most:
        state = dict(sorted(state.items(), key=lambda kv: (-kv[1], kv[0]))[:most])
    return state


def outcomes(df: DataFrame, keys: list[str], order: str, outcome: str) -> DataFrame:
    """State of queued items after their outcomes: engaged or dropped ends them, two deflections retire them, whichever comes first.

    The first end and the second deflection decide, which are minima that are
    combined before the shuffle.
    """
    kind, at = F.col(outcome), F.col(order)
    firsts = df.groupBy(*keys).agg(F.min(F.when(kind == "deflected", at)).alias("_first"))
    ends = kind.isin("engaged", "dropped")
    sums = df.join(firsts, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(F.when(ends, at)).alias("_end"),
        F.min_by(F.when(ends, kind), F.when(ends, at)).alias("_as"),
        F.min(F.when((kind == "deflected") & (at > F.col("_first")), at)).alias("_retires"),
        F.count_if(kind == "deflected").alias("deflected"),
    )
    retired = F.col("_retires").isNotNull() & (F.col("_end").isNull() | (F.col("_retires") < F.col("_end")))
    return sums.select(*keys, "n", F.when(retired, "retired").otherwise(F.coalesce("_as", F.lit("open"))).alias("status"), F.col("deflected").cast("int").alias("deflected"))


# What counts as a word or a mark in a text.
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9'\-]*|[^\sA-Za-z0-9]")


def keyphrases(text: str, most: int = 12, stop_words: frozenset[str] = frozenset(STOP_WORDS), least: int = 3, width: int = 4) -> list[tuple[str, float]]:
    """The best (phrase, score): runs of content words, cut every `width`, by the sum of their words' degree over frequency.

    Stop words, words under `least` letters, numbers and marks end a run. A
    word's degree is the length of all phrases that it stands in.
    """
    words = (t.lower().strip("'-") for t in _TOKEN.findall(text))
    content = [w if len(w) >= least and w not in stop_words and any(map(str.isalpha, w)) else "" for w in words]
    runs = [list(run) for full, run in groupby(content, bool) if full]
    phrases = [run[i : i + width] for run in runs for i in range(0, len(run), width)]
    frequency = Counter(w for p in phrases for w in p)
    degree = Counter()
    for p in phrases:
        degree.update({w: n * len(p) for w, n in Counter(p).items()})
    scores = {" ".join(p): round(sum(degree[w] / frequency[w] for w in p), 6) for p in phrases}
    return sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:most]


def with_keyphrases(docs: DataFrame, ident: str, text: str, most: int = 12) -> DataFrame:
    """(ident, rank, phrase, score) of every text's keyphrases, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, r, p, s) for i, t in zip(batch[ident], batch[text]) for r, (p, s) in enumerate(keyphrases(t or "", most), 1)]
            yield pd.DataFrame(rows, columns=[ident, "rank", "phrase", "score"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInPandas(run, f"{ident} {kind}, rank long, phrase string, score double")
