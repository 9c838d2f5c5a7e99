"""Batches of a stream that count once, in bounded steps, around rows that can't be processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import _written
from ..operators.publish import Store

Step = Callable[[DataFrame], DataFrame]


def around_poison(rows: DataFrame, step: Step, ident: str, alive: Callable[[], bool] = lambda: True) -> tuple[list[DataFrame], DataFrame]:
    """(results of step(), rows that it fails on).

    A batch that fails is halved by id until only the rows that fail are left, so
    n such rows cost some n log(batch) steps. alive() is asked before a row is
    given up; if it says no, the failure is raised, and nothing is skipped.
    """
    rows = _written(rows)
    made, skipped = [], []

    def work(part: DataFrame) -> None:
        try:
            made.append(_written(step(part)))
        except Exception:
            low, high, n = part.agg(F.min(ident), F.max(ident), F.count("*")).first()
            if low == high:
                if not alive():
                    raise
                skipped.append(part)
                return
            middle = part.agg(F.percentile_approx(ident, F.lit(0.5), F.lit(10_000))).first()[0]
            middle = middle if middle < high else low
            work(part.where(F.col(ident) <= middle))
            work(part.where(F.col(ident) > middle))

    if not rows.isEmpty():
        work(rows)
    gone = rows.where("false")
    for part in skipped:
        gone = gone.union(part)
    return made, gone


def counted_once(store: Store, name: str, step: Step, checks: dict[str, Column] | None = None, ident: str | None = None, alive: Callable[[], bool] = lambda: True):
    """A function for foreachBatch: step()'s rows of each batch are published to the store, with the batch's number in the manifest.

    The manifest and the number appear at once, so a batch that Spark replays
    after a failure between write and commit is found there and adds nothing.
    With `ident`, rows that step() fails on go to the table `name`.skipped
    instead of stopping the stream.
    """

    def each(rows: DataFrame, number: int) -> None:
        if store.batch(name, str(number)):
            return
        if ident is None:
            made = step(rows)
        else:
            parts, gone = around_poison(rows, step, ident, alive)
            made = parts[0] if parts else None
            for part in parts[1:]:
                made = made.unionByName(part)
            if not gone.isEmpty():
                store.publish(f"{name}.skipped", gone, append=True, batch=str(number))
        if made is not None:
            store.publish(name, made, checks, append=True, batch=str(number))

    return each
