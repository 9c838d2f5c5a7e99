"""Structured Streaming versions of the windowed and stateful operators.

Each takes a streaming (or static) DataFrame and returns a lazy one; the caller
starts it with a checkpoint location and a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import TAU, activate


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and key; rows later than `late` are dropped once their window is closed (the watermark is an addition)."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_windows(events: DataFrame, ts: str, keys: list[str], gap: str, least: int = 1, late: str = "1 day") -> DataFrame:
    """Sessions of each key that end after `gap` of silence, with at least `least` events."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    found = timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def ingest_stream(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def activation_stream(events: DataFrame, key: str, ts: str, item: str, idle: float = 12 * TAU) -> DataFrame:
    """(key, item, activation) after each batch; rows of a batch are folded in ts order. ts in seconds.

    A key without events for `idle` seconds has decayed below the floor; its
    state is dropped.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        names, values, last = held.get if held.exists else ([], [], None)
        state = dict(zip(names, values))
        for row in pd.concat(list(batches)).sort_values([ts, item]).itertuples():
            now = getattr(row, ts)
            state, last = activate(now, [getattr(row, item)], state, last), now
        held.update((list(state), list(state.values()), last))
        held.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame({key: k[0], "item": list(state), "activation": [round(v, 6) for v in state.values()]})

    state = "names array<string>, acts array<double>, last double"
    grouped = events.select(key, ts, item).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, item string, activation double", state, "update", GroupStateTimeout.ProcessingTimeTimeout)
