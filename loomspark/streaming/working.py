"""The phrase graph of running conversations, in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.working import EDGES, MEASURES, NODES, Edge, Node, PhraseGraph, Rules, with_phrases

_NODE = "value double, at double, turns array<int>, clauses array<string>, dormant boolean"
_EDGE = "weight double, at double, turns array<int>"
_META = "turn long, low long, frame array<string>, seed array<string>, timer long"


class GraphProcessor(StatefulProcessor):
    """Nodes and edges in map states, counters in a value state. Only entries that a turn touches are written: the others decay when they are read."""

    def __init__(self, key: str, order: str, rules: Rules, idle_ms: int) -> None:
        self.key, self.order, self.rules, self.idle_ms = key, order, rules, idle_ms
        self.names = [key, "kind", order, *(c.split(" ")[0] for c in MEASURES.split(", ")), "held_nodes", "held_edges"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getMapState("nodes", "label string", _NODE)
        self.edges = handle.getMapState("edges", "a string, b string", _EDGE)
        self.meta = handle.getValueState("meta", _META)

    def _graph(self) -> tuple[PhraseGraph, int]:
        graph, timer = PhraseGraph(self.rules), 0
        if self.meta.exists():
            graph.turn, graph.low, frame, seed, timer = self.meta.get()
            graph.frame, graph.seed = list(frame), list(seed)
            graph.nodes = {k[0]: Node(v[0], v[1], list(v[2]), list(v[3]), v[4]) for k, v in self.nodes.iterator()}
            graph.edges = {(k[0], k[1]): Edge(v[0], v[1], list(v[2])) for k, v in self.edges.iterator()}
        return graph, timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        graph, timer = self._graph()
        out, at = [], 0.0
        for place, at, phrases in pd.concat(list(rows)).sort_values("place")[["place", "at", "phrases"]].itertuples(index=False):
            measures = graph.step(float(at), [(p["phrase"], p["clause"]) for p in phrases])
            out.append((key[0], "turn", int(place), *measures.values(), None, None))
        for x in graph.touched:
            held, state = (graph.edges, self.edges) if isinstance(x, tuple) else (graph.nodes, self.nodes)
            name, entry = x if isinstance(x, tuple) else (x,), held.get(x)
            if entry is not None:
                state.updateValue(name, (entry.value, entry.at, entry.turns, entry.clauses, entry.dormant) if held is graph.nodes else (entry.weight, entry.at, entry.turns))
            elif state.containsKey(name):
                state.removeKey(name)
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(timer, int(at * 1000) + self.idle_ms)
        self.handle.registerTimer(timer)
        self.meta.update((graph.turn, graph.low, graph.frame, graph.seed, timer))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A conversation that is over: its notes, to be carried to the next one, and no state."""
        graph, _ = self._graph()
        for state in (self.nodes, self.edges, self.meta):
            state.clear()
        yield pd.DataFrame([(key[0], "notes", None, *[None] * len(MEASURES.split(", ")), *graph.notes())], columns=self.names)

    def close(self) -> None:
        pass


def graph_stream(turns: DataFrame, key: str, order: str, ts: str, text: str, rules: Rules = Rules(), idle: float = 12 * 900.0, late: str = "1 hour") -> DataFrame:
    """graph_turns() of a stream: a row of kind `turn` for every turn, and one of kind `notes` when a conversation was idle for `idle` seconds.

    Turns of a conversation are folded as they arrive, those of one batch by
    `order`; turns over `late` behind the newest of all may be dropped, and idle
    conversations end when that watermark passes their time. State is bounded by the graph's bounds for each conversation that
    isn't idle. The session needs the RocksDB state store.
    """
    said = with_phrases(turns.select(F.col(key), F.col(order).cast("long").alias("place"), F.col(ts).cast("double").alias("at"), F.col(text).alias("said")).where(F.col(key).isNotNull()), "said", rules)
    said = said.withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", late)
    kind = f"{key} {turns.schema[key].dataType.simpleString()}, kind string, {order} long, {MEASURES}, held_nodes {NODES}, held_edges {EDGES}"
    return said.groupBy(key).transformWithStateInPandas(GraphProcessor(key, order, rules, int(idle * 1000)), kind, "Update", "EventTime")
