"""Sentences out of texts that arrive in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: a sentence ends with marks, closing quotes or brackets, and one white space.
END = r"[.!?…]+[\"')\]]*[ \t\n\r\f]"
_END = re.compile(END)


def spoken(text: Column) -> Column:
    """The sentences of a whole text, trimmed, blank ones left out; what follows the last end is one too."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({END})", "$1\x01"), "\x01")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


class Flush(StatefulProcessor):
    """Holds the sentence that isn't whole yet, and how many were given."""

    def __init__(self, key: str, idle_ms: int) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rest string, n long, timer long")

    def _rows(self, key, said: list[str], n: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], n + i, s) for i, s in enumerate(said)], columns=[self.key, "n", "sentence"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, n, timer = self.held.get() if self.held.exists() else ("", 0, 0)
        said, at = [], 0.0
        for _, at, piece, last in pd.concat(list(rows)).sort_values("place")[["place", "at", "piece", "last"]].itertuples(index=False):
            rest += piece or ""
            done = 0
            for m in _END.finditer(rest):
                said.append(rest[done : m.end()].strip())
                done = m.end()
            rest = rest[done:]
            if last:
                said.append(rest.strip())
                rest = ""
        said = [s for s in said if s]
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(timer, int(at * 1000) + self.idle_ms)
        self.handle.registerTimer(timer)
        self.held.update((rest, n + len(said), timer))
        yield self._rows(key, said, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, n, _ = self.held.get()
        self.held.clear()
        yield self._rows(key, [rest.strip()] if rest.strip() else [], n)

    def close(self) -> None:
        pass


def sentence_stream(pieces: DataFrame, key: str, order: str, ts: str, text: str, last: Column | None = None, idle: float = 30.0, late: str = "1 minute") -> DataFrame:
    """(key, n, sentence): every sentence once its end has arrived, numbered from 0.

    Pieces of a key are joined as they arrive, those of one batch by `order`. The
    rest is given with the piece that `last` marks, or when the watermark is
    `idle` seconds past the key's newest piece, when its state goes too. However
    a text is cut, its sentences are those of spoken(). ts in seconds; the
    session needs the RocksDB state store.
    """
    slim = pieces.select(
        F.col(key), F.col(order).cast("long").alias("place"), F.col(ts).cast("double").alias("at"), F.col(text).alias("piece"), (F.lit(False) if last is None else F.coalesce(last, F.lit(False))).alias("last")
    ).where(F.col(key).isNotNull())
    timed = slim.withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", late)
    kind = f"{key} {pieces.schema[key].dataType.simpleString()}, n long, sentence string"
    return timed.groupBy(key).transformWithStateInPandas(Flush(key, int(idle * 1000)), kind, "Update", "EventTime")
