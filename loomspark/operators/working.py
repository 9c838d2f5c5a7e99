"""Working memory of conversations: associative activation as composable functions, and the phrase graph with its two decay clocks.

Activation has a closed form per item, so it is an aggregate. The graph's
nodes depend on each other through its bounds, so turns are folded in order,
one at a time, in bounded state; what can be done per turn (phrases and their
clauses) is done before, in parallel.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import FLOOR, MOST, TAU, activate, keyphrases

#: Boosts of an item that was surfaced and of one that was mentioned.
SURFACED, MENTIONED = 0.5, 0.35
#: Seconds in which functions are combined first, and how many such pieces are combined next.
PIECE, PIECES = 3600.0, 1024
#: Events of an item that are folded at once.
FEW = 4096
#: Rows with phrases or notes that a task makes at a time.
SLICE = 64


# --- activation ---------------------------------------------------------------------------------------------------

_EMPTY = "CAST(NULL AS STRUCT<first: DOUBLE, last: DOUBLE, below: DOUBLE, least: DOUBLE, a: DOUBLE, b: DOUBLE, c: DOUBLE>)"


def _then(f: Column, g: Column, tau: float) -> Column:
    """The function of f's events and then g's.

    A run of events takes x, the activation as decayed to its first event, to
    the activation after its last one: x < below ? least : min(c, a x + b). This
    form is closed: between the runs activation decays by e, and if what f gives
    is too low for g's `below`, the item begins anew, as g's least says; f rises,
    so that is the case below some x only, and there all x end alike.
    """
    e = F.exp((f["last"] - g["first"]) / tau)

    def of_g(y: Column) -> Column:
        return F.when(y < g["below"], g["least"]).otherwise(F.least(g["c"], g["a"] * y + g["b"]))

    reached = F.when(f["a"] > 0, (g["below"] / e - f["b"]) / f["a"])  # where f's rising part is high enough for g
    never = e * f["c"] < g["below"]
    below = F.when(never, F.lit(float("inf"))).otherwise(F.greatest(f["below"], F.coalesce(reached, f["below"])))
    return F.struct(
        f["first"].alias("first"),
        g["last"].alias("last"),
        below.alias("below"),
        of_g(e * f["least"]).alias("least"),
        (g["a"] * e * f["a"]).alias("a"),
        (g["a"] * e * f["b"] + g["b"]).alias("b"),
        F.least(g["c"], g["a"] * e * f["c"] + g["b"]).alias("c"),
    )


def _combined(df: DataFrame, keys: list[str], part: Column, tau: float) -> DataFrame:
    """The functions `f` of each key and part, in the order of their times, as one."""
    listed = df.groupBy(*keys, part.alias("_part")).agg(F.sort_array(F.collect_list("f")).alias("all"))
    whole = F.aggregate("all", F.expr(_EMPTY), lambda f, g: F.when(f.isNull(), g).otherwise(_then(f, g, tau)))
    return listed.select(*keys, whole.alias("f"))


def activation(df: DataFrame, key: str, ts: str, item: str, boost: Column | float = SURFACED, tau: float = TAU, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """(key, item, activation) at each key's last event: boosts up to 1, exponential decay, forgotten below the floor.

    Events are counted first. An item of a key with up to FEW events is folded in
    order, in the one shuffle. Of one with more, boosts of a moment add up before
    the shuffle, and each moment is a function of the activation before it;
    functions of an hour are combined to one, then those of PIECES hours, then
    the rest, so a hot key or item is split by time and no task holds more than
    the moments of an hour. Decay
    multiplies, so it only matters at the item's own events whether it has fallen
    below the floor, and items don't depend on each other, but for the bound of
    `most` per key: keys that may have had more within the time an activation
    lives are folded in order, in bounded memory (`folded`). ts in seconds; rows
    without a key, item or time are ignored; an empty table gives none.
    """
    events = df.select(F.col(key).alias(key), F.col(ts).cast("double").alias("_at"), F.col(item).cast("string").alias("item"), (boost if isinstance(boost, Column) else F.lit(float(boost))).cast("double").alias("_boost"))
    events = events.where(F.col(key).isNotNull() & F.col("_at").isNotNull() & F.col("item").isNotNull() & (F.col("_boost") > 0))
    several = events.groupBy(key, "item").agg(F.count("*").alias("n"))
    longest, items = several.groupBy(key).agg(F.max("n").alias("n"), F.count("*").alias("items")).agg(F.max("n"), F.max("items")).first()
    same = [F.col(key) == F.col("_key"), F.col("item") == F.col("_item")]
    crowded = None
    if (items or 0) > most:
        # a window of the time that an activation lives lies in two neighbouring spans
        many = several.groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("items")).where(F.col("items") > most)
        span = F.floor(F.col("_at") / (tau * math.log(1 / floor)))
        held = events.join(many, F.col(key) == F.col("_many"), "left_semi").groupBy(key, span.alias("_span"), "item").agg(F.count("*").alias("n")).groupBy(key, "_span").agg(F.count("*").alias("n"))
        around = held.select(key, F.explode(F.array("_span", F.col("_span") + 1)).alias("_span"), "n").groupBy(key, "_span").agg(F.sum("n").alias("n"))
        crowded = around.where(F.col("n") > most).select(F.col(key).alias("_crowded")).distinct()
    free = events if crowded is None else events.join(crowded, F.col(key) == F.col("_crowded"), "left_anti")
    few = free
    if (longest or 0) > FEW:
        hot = several.where(F.col("n") > FEW).select(F.col(key).alias("_key"), F.col("item").alias("_item"))
        few = free.join(hot, same, "left_anti")
    listed = few.groupBy(key, "item").agg(F.sort_array(F.collect_list(F.struct("_at", F.col("_boost").alias("b")))).alias("all"))

    def step(x: Column, e: Column) -> Column:
        v = x["v"] * F.exp((x["last"] - e["_at"]) / tau)
        before = F.when(x["last"] == e["_at"], x["v"]).when(v < floor, F.lit(0.0)).otherwise(v)
        return F.struct(F.least(F.lit(1.0), F.coalesce(before, F.lit(0.0)) + e["b"]).alias("v"), e["_at"].alias("last"))

    none = F.expr("CAST(NULL AS STRUCT<v: DOUBLE, last: DOUBLE>)")
    whole = listed.select(key, "item", F.aggregate("all", none, step).alias("f")).select(key, "item", "f.v", "f.last")
    if (longest or 0) > FEW:
        f = F.struct(
            F.col("_at").alias("first"), F.col("_at").alias("last"), F.lit(floor).alias("below"), F.least(F.lit(1.0), F.col("b")).alias("least"),
            F.lit(1.0).alias("a"), F.col("b").alias("b"), F.lit(1.0).alias("c"),
        )
        moments = free.join(hot, same, "left_semi").groupBy(key, "item", "_at").agg(F.sum("_boost").alias("b"))
        pieces = _combined(moments.select(key, "item", f.alias("f")), [key, "item"], F.floor(F.col("f.first") / PIECE), tau)
        pieces = _combined(pieces, [key, "item"], F.floor(F.col("f.first") / (PIECE * PIECES)), tau)
        split = _combined(pieces, [key, "item"], F.lit(0), tau)
        # an item begins without activation, and a boost lifts it over the floor
        whole = whole.unionByName(split.select(key, "item", F.col("f.least").alias("v"), F.col("f.last").alias("last")))
    ends = events.groupBy(F.col(key).alias("_key")).agg(F.max("_at").alias("_end"))
    now = whole.join(ends, F.col(key) == F.col("_key")).select(key, "item", "v", (F.col("_end") - F.col("last")).alias("dt"))
    value = F.col("v") * F.exp(-F.col("dt") / tau)
    found = now.select(key, "item", value.alias("v"), "dt").where((F.col("dt") <= 0) | (F.col("v") >= floor)).select(key, "item", F.round("v", 6).alias("activation"))
    if crowded is None:
        return found
    packed = events.join(crowded, F.col(key) == F.col("_crowded"), "left_semi").groupBy(key, "item", "_at").agg(F.sum("_boost").alias("b"))
    return found.unionByName(folded(packed, key, "_at", "item", "b", tau, floor, most))


def folded(df: DataFrame, key: str, ts: str, item: str, boost: str, tau: float = TAU, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """activation() moment by moment, in order: the state of one key at a time, whatever the number of its events."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, last = None, {}, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({key: [now] * len(state), "item": list(state), "activation": [round(v, 6) for v in state.values()]})

        for batch in batches:
            for k, at, name, b in zip(batch[key], batch[ts], batch[item], batch[boost]):
                if k != now:
                    if now is not None:
                        yield out()
                    now, state, last = k, {}, None
                state, last = activate(at, [name], state, last, b, tau, floor, most), at
        if now is not None:
            yield out()

    ordered = df.select(key, ts, item, boost).repartition(key).sortWithinPartitions(key, ts, item)
    return ordered.mapInPandas(run, f"{key} {kind}, item string, activation double")


# --- the phrase graph ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Parameters of a phrase graph."""

    # Decay times of attention and of carried notes in seconds, boost, floor, bounds and limits.
    tau: float = 900.0
    carried_tau: float = 604800.0
    boost: float = 0.4
    floor: float = 0.02
    nodes: int = 256
    edges: int = 512
    frame: int = 12
    phrases: int = 12
    linked: int = 6
    turns: int = 8
    clauses: int = 3
    clause_chars: int = 160
    least_entropy: float = 1.0
    stall: int = 4
    carry: float = 0.6
    least_weight: float = 0.1
    brief_chars: int = 1200
    brief_clauses: int = 6
    brief_clause_chars: int = 120
    threads: int = 5
    #: Words that are no phrase by themselves.
    common: frozenset[str] = frozenset()


_CLAUSE = re.compile(r"[^.!?\n]+[.!?]*")
HEADER = "Notes on this conversation so far; they may be wrong:"


def phrases_of(text: str, rules: Rules) -> list[tuple[str, str]]:
    """The best phrases of a turn, each with the first clause that has it (cut; empty if none has)."""
    clauses = [" ".join(c.split()) for c in _CLAUSE.findall(text or "") if c.strip()]
    found = []
    for phrase, _ in keyphrases(text or "", rules.phrases):
        if phrase not in rules.common:
            found.append((phrase, next((c[: rules.clause_chars] for c in clauses if phrase in c.lower()), "")))
    return found


@dataclass
class Node:
    """Activation `value` at time `at`; it decays when it is looked at, so nodes that a turn doesn't touch aren't written."""

    value: float
    at: float
    turns: list[int] = field(default_factory=list)
    clauses: list[str] = field(default_factory=list)
    dormant: bool = False


@dataclass
class Edge:
    weight: float
    at: float
    turns: list[int] = field(default_factory=list)


class PhraseGraph:
    """One conversation's phrases and their links. touched and gone tell which nodes and edges the last turns changed."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.turn = rules, 0
        self.nodes: dict[str, Node] = {}
        self.edges: dict[tuple[str, str], Edge] = {}
        self.frame: list[str] = []
        self.seed: list[str] = []
        self.low = 0
        self.woken: dict[str, list[str]] = {}
        self.touched: set = set()

    def value(self, node: Node, now: float) -> float:
        tau = self.rules.carried_tau if node.dormant else self.rules.tau
        return node.value * math.exp(-max(0.0, now - node.at) / tau)

    def wake(self, nodes: list, edges: list, now: float) -> None:
        """Take over notes of an earlier conversation, dormant: faded by the slow clock, out of the frame until they are mentioned."""
        r = self.rules
        for n in nodes:
            value = n["value"] * math.exp(-max(0.0, now - n["at"]) / r.carried_tau) * r.carry
            if value >= r.floor and n["label"] not in r.common:
                self.nodes[n["label"]] = Node(value, now, list(n["turns"])[-r.turns :] or [0], list(n["clauses"])[-r.clauses :], True)
        for e in edges:
            weight = e["weight"] * math.exp(-max(0.0, now - e["at"]) / r.carried_tau)
            if e["a"] in self.nodes and e["b"] in self.nodes and weight >= r.least_weight:
                self.edges[e["a"], e["b"]] = Edge(weight, now, list(e["turns"])[-r.turns :] or [0])
        self.touched |= set(self.nodes) | set(self.edges)
        self._bound(now)

    def step(self, now: float, phrases: list[tuple[str, str]]) -> dict:
        """Fold one turn; gives its measures."""
        r, before = self.rules, set(self.frame)
        self.turn += 1
        self.woken = {}
        for phrase, clause in phrases:
            node = self.nodes.get(phrase)
            if node is None:
                node = self.nodes[phrase] = Node(0.0, now)
            elif node.dormant:
                self.woken[phrase] = list(node.clauses)
            node.value, node.at = min(1.0, self.value(node, now) + r.boost), max(node.at, now)
            node.dormant = False
            node.turns = [*(t for t in node.turns if t != self.turn), self.turn][-r.turns :]
            if clause and clause not in node.clauses:
                node.clauses = [*node.clauses, clause][-r.clauses :]
            self.touched.add(phrase)
        for pair in combinations(sorted({p for p, _ in phrases[: r.linked]}), 2):
            edge = self.edges.setdefault(pair, Edge(0.0, now))
            edge.weight, edge.at = edge.weight + 1, now
            edge.turns = [*(t for t in edge.turns if t != self.turn), self.turn][-r.turns :]
            self.touched.add(pair)
        values = self._bound(now)
        self.seed = self.seed or self.frame
        active = [v for n, v in values.items() if not self.nodes[n].dormant]
        total = sum(active)
        entropy = round(-sum(v / total * math.log(v / total) for v in active if v > 0), 4) + 0.0 if total > 0 else 0.0
        churn, drift = (round(1 - _alike(set(self.frame), other), 4) for other in (before, set(self.seed)))
        if len(active) < r.frame:
            self.low = 0
        else:
            self.low = self.low + 1 if entropy < r.least_entropy or churn == 0 else 0
        return {
            "turn": self.turn, "nodes": len(self.nodes), "dormant": len(self.nodes) - len(active), "woke": len(self.woken), "edges": len(self.edges),
            "entropy": entropy, "churn": churn, "drift": drift, "stalled": self.low >= r.stall, "frame": list(self.frame), "briefing": self.briefing(),
        }

    def _bound(self, now: float) -> dict[str, float]:
        """Drop what is below the floor or beyond the bounds, and choose the frame; gives the activations now."""
        r = self.rules
        values = {n: self.value(x, now) for n, x in self.nodes.items()}
        ranked = sorted((n for n, v in values.items() if v >= r.floor), key=lambda n: (-values[n], n))
        for n in self.nodes.keys() - set(ranked[: r.nodes]):
            del self.nodes[n]
            self.touched.add(n)
        ranked = ranked[: r.nodes]
        held = sorted((e for e in self.edges if e[0] in self.nodes and e[1] in self.nodes), key=lambda e: (-self.edges[e].weight, e))
        for e in self.edges.keys() - set(held[: r.edges]):
            del self.edges[e]
            self.touched.add(e)
        self.frame = [n for n in ranked if not self.nodes[n].dormant][: r.frame]
        return {n: values[n] for n in ranked}

    def briefing(self) -> str:
        """The frame as lines, each with the latest clause that no line above has, and the strongest links."""
        r, lines, shown = self.rules, [HEADER], set()
        for n in self.frame:
            clauses = self.woken.get(n) or self.nodes[n].clauses
            clause = next((c for c in reversed(clauses) if c.lower() not in shown), None) if len(shown) < r.brief_clauses else None
            if clause:
                shown.add(clause.lower())
            lines.append(f"- {n}" + (f': "{clause[: r.brief_clause_chars]}"' if clause else "") + (" (earlier)" if clause and self.woken.get(n) else ""))
        links = sorted(self.edges, key=lambda e: (-self.edges[e].weight, e))[: r.threads]
        if links:
            lines.append("Links: " + "; ".join(f"{a} · {b}" for a, b in links))
        return "\n".join(lines)[: r.brief_chars] if self.frame else ""

    def notes(self) -> tuple[list[dict], list[dict]]:
        """Nodes and edges as rows."""
        nodes = [{"label": n, "value": x.value, "at": x.at, "turns": x.turns, "clauses": x.clauses, "dormant": x.dormant} for n, x in sorted(self.nodes.items())]
        return nodes, [{"a": a, "b": b, "weight": e.weight, "at": e.at, "turns": e.turns} for (a, b), e in sorted(self.edges.items())]


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


PHRASES = "array<struct<phrase:string,clause:string>>"
NODES = "array<struct<label:string,value:double,at:double,turns:array<int>,clauses:array<string>,dormant:boolean>>"
EDGES = "array<struct<a:string,b:string,weight:double,at:double,turns:array<int>>>"
MEASURES = "turn long, nodes long, dormant long, woke long, edges long, entropy double, churn double, drift double, stalled boolean, frame array<string>, briefing string"


def with_phrases(turns: DataFrame, text: str, rules: Rules = Rules()) -> DataFrame:
    """turns with a column phrases instead of the text, turn by turn, before anything is shuffled."""
    schema = turns.drop(text).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.iloc[at : at + SLICE]
                found = [[{"phrase": p, "clause": c} for p, c in phrases_of(t, rules)] for t in batch[text]]
                yield batch.drop(columns=[text]).assign(phrases=pd.Series(found, index=batch.index, dtype=object))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return turns.mapInPandas(run, f"{columns}, phrases {PHRASES}")


def _fold(turns: DataFrame, key: str, order: str, ts: str, text: str, rules: Rules, carried: DataFrame | None, schema: str, each: bool) -> DataFrame:
    said = with_phrases(turns.select(F.col(key), F.col(order).cast("long").alias("_order"), F.col(ts).cast("double").alias("_at"), text).where(F.col(key).isNotNull()), text, rules)
    rows = said.select(key, F.lit(1).alias("_kind"), "_order", "_at", "phrases", F.lit(None).cast(NODES).alias("_nodes"), F.lit(None).cast(EDGES).alias("_edges"))
    if carried is not None:
        kept = carried.select(key, F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast(PHRASES), F.col("nodes").cast(NODES), F.col("edges").cast(EDGES))
        rows = rows.union(kept.join(rows.select(F.col(key).alias("_has")).distinct(), F.col(key) == F.col("_has"), "left_semi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, graph, waiting = None, PhraseGraph(rules), None
        for batch in batches:
            out = []
            for k, kind, place, at, phrases, nodes, edges in batch.itertuples(index=False):
                if k != now:
                    if now is not None and not each:
                        out.append((now, *graph.notes()))
                    now, graph, waiting = k, PhraseGraph(rules), None
                if kind == 0:
                    waiting = nodes, edges
                    continue
                if waiting:
                    graph.wake(*waiting, at)
                    waiting = None
                measures = graph.step(at, [(p["phrase"], p["clause"]) for p in phrases])
                graph.touched.clear()
                if each:
                    out.append((k, int(place), *measures.values()))
                if len(out) >= SLICE:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)
        if now is not None and not each:
            yield pd.DataFrame([(now, *graph.notes())], columns=names)

    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return rows.repartition(key).sortWithinPartitions(key, "_kind", "_order").mapInPandas(run, schema)


def graph_turns(turns: DataFrame, key: str, order: str, ts: str, text: str, rules: Rules = Rules(), carried: DataFrame | None = None) -> DataFrame:
    """One row per turn: what its conversation's phrase graph measures after it (MEASURES).

    A turn's phrases gain activation and are linked; what has decayed below the
    floor goes, as do the weakest beyond the bounds, and the strongest make the
    frame. churn and drift compare the frame with the one before and the first
    one; a full frame that doesn't move, or whose activations bunch, stalls after
    some turns. `carried` has notes of earlier conversations (graph_notes()).

    Turns are folded in order with one conversation's bounded graph in memory,
    whatever the conversation's length. Null texts have no phrases but let time
    pass; rows without a key are ignored; ts in seconds; an empty table gives
    none.
    """
    return _fold(turns, key, order, ts, text, rules, carried, f"{key} {turns.schema[key].dataType.simpleString()}, {order} long, {MEASURES}", True)


def graph_notes(turns: DataFrame, key: str, order: str, ts: str, text: str, rules: Rules = Rules(), carried: DataFrame | None = None) -> DataFrame:
    """(key, nodes, edges) after each conversation's last turn, to be carried over to the next."""
    return _fold(turns, key, order, ts, text, rules, carried, f"{key} {turns.schema[key].dataType.simpleString()}, nodes {NODES}, edges {EDGES}", False)
